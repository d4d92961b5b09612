"""Search over a key list: substring, word, batch, regular-expression and edit-distance modes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MODES = ("contain", "begin", "end", "containcase", "containword", "containcaseword", "contain*", "containcase*", "containword*", "containcaseword*", "regex", "edit", "editbin")


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, _UPPER, _LOWER)


def quoted(text: str) -> str:
    """A pattern that matches text itself, in Java's engine and in RE2."""
    return re.sub(r"([^0-9A-Za-z\s\x80-\U0010FFFF_])", r"\\\1", text)


def word_pattern(text: str, edges: bool = False) -> str:
    """text with no ASCII letter or digit beside it on a side where it ends in one itself (edges: on both sides in any case)."""
    left = "(?<![0-9A-Za-z])" if edges or re.match("[0-9A-Za-z]", text) else ""
    right = "(?![0-9A-Za-z])" if edges or re.search("[0-9A-Za-z]$", text) else ""
    return f"{left}{quoted(text)}{right}"


def matches(c: Column, mode: str, pattern: str) -> Column:
    """C-01 to C-11: whether c matches. A starred mode takes patterns by lines, empty ones dropped, and asks for any.

    A batch of words assumes that each pattern starts and ends in a letter or digit; without any it matches what an empty word does: an empty line
    or two other characters in a row. A batch of substrings without any matches nothing.
    """
    if mode.endswith("*"):
        lines = [p for p in pattern.split("\n") if p]
        folded = "case" in mode
        lines = [p.translate(str.maketrans(_UPPER, _LOWER)) for p in lines] if folded else lines
        text = ascii_lower(c) if folded else c
        if "word" in mode:
            return text.rlike("|".join(word_pattern(p, True) for p in lines) or "^$|[^0-9A-Za-z][^0-9A-Za-z]")
        return text.rlike("|".join(map(quoted, lines))) if lines else F.lit(False)
    if mode == "contain":
        return c.contains(pattern)
    if mode == "begin":
        return c.startswith(pattern)
    if mode == "end":
        return c.endswith(pattern)
    if mode == "containcase":
        return ascii_lower(c).contains(pattern.translate(str.maketrans(_UPPER, _LOWER)))
    if mode == "containword":
        return c.rlike(word_pattern(pattern))
    if mode == "containcaseword":
        return ascii_lower(c).rlike(word_pattern(pattern.translate(str.maketrans(_UPPER, _LOWER))))
    if mode == "regex":
        return c.rlike(pattern)
    raise ValueError(f"unknown mode: {mode}")


def search(keys: DataFrame, mode: str, pattern: str, capacity: int = 0, column: str = "key", order: str = "freq_rank") -> DataFrame:
    """C-12, W-09: the first `capacity` matching keys in the list's order; by edit distance the nearest (`dist`, key). 0: all.

    Top rows come from a bounded heap a task, so no sort of all keys takes place where a capacity is given.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode.startswith("edit"):
        text = F.col(column)
        far = F.levenshtein(text, F.lit(pattern)) if mode == "edit" else F.levenshtein(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(pattern.encode().decode("latin-1")))
        found = keys.withColumn("dist", far).orderBy("dist", column)
    else:
        found = keys.where(matches(F.col(column), mode, pattern)).orderBy(order)
    return found.limit(capacity) if capacity else found


def batch_contains(keys: DataFrame, patterns: DataFrame, column: str = "key", pattern: str = "pattern", gram: int = 3) -> DataFrame:
    """C-07 with patterns as a table: keys that contain any of them. Keys and patterns meet on the patterns' first `gram` characters.

    Patterns under `gram` characters are few at most (every key is compared with them); Spark plans that join by their size.
    """
    p = patterns.select(F.col(pattern).alias("__p")).where("__p <> ''").distinct()
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(column) - (gram - 1))), lambda i: F.substring(F.col(column), i, F.lit(gram)))
    met = keys.select(column, F.explode(F.array_distinct(grams)).alias("__g")).join(p.where(F.char_length("__p") >= gram).withColumn("__h", F.substring("__p", 1, gram)), F.col("__g") == F.col("__h")).where(F.col(column).contains(F.col("__p")))
    short = keys.select(column).join(p.where(F.char_length("__p") < gram), F.col(column).contains(F.col("__p")))
    return keys.join(met.select(column).unionByName(short.select(column)).distinct(), column, "left_semi")
