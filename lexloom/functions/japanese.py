"""Normalisation and variants of Japanese answers, for matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import SPACE

# Marks and punctuation that matching ignores, trailing particles, and suffixes of inflection or derivation.
MIDDLE_DOTS, LONG_VOWELS = "[・･·•]", "[ー―—–]"
PUNCTUATION = r"[。、，．,\.!?！？「」『』（）()\[\]【】:：;；\"'’“”]"
PARTICLES = "する|した|して|される|された|すること|をする|な|に|の|は|が|を|で|と|も|へ|や"
SUFFIXES = tuple("している していた させる させ された される する した して 的な 的に の な に た で と さ み 的 性 化 者 屋 式 風 用 済 中 後 前 付き 付".split())
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def to_hiragana(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def to_katakana(c: Column) -> Column:
    return F.translate(c, HIRAGANA, KATAKANA)


def normalized(c: Column, compatible: bool = True) -> Column:
    """F-10: one spelling for matching: NFKC, no middle dots, long vowels or punctuation, hiragana, folded case. Null: empty.

    compatible=False leaves out NFKC and uses lower case, for input known to be in that form: then nothing leaves the JVM.
    """
    value = F.coalesce(c, F.lit(""))
    value = _compatible(value) if compatible else value
    value = F.regexp_replace(value, r"[\x{3099}\x{309A}]", "")
    value = F.regexp_replace(F.regexp_replace(value, f"{SPACE}+", " "), "^ | $", "")
    value = to_hiragana(F.regexp_replace(F.regexp_replace(value, MIDDLE_DOTS, ""), LONG_VOWELS, ""))
    value = F.regexp_replace(value, PUNCTUATION, "")
    return F.regexp_replace(_folded(value) if compatible else F.lower(value), f"^{SPACE}+|{SPACE}+$", "")


def strict(normal: Column) -> Column:
    """F-11 of a normalised string: trailing particles off, as often as there are any."""
    return F.regexp_replace(normal, f"(?:{PARTICLES})+$", "")


def spellings(normal: Column) -> Column:
    """F-13 of a normalised string: itself, without particles, in katakana and in hiragana; distinct and not empty."""
    return F.array_distinct(F.filter(F.array(normal, strict(normal), to_katakana(normal), to_hiragana(normal)), lambda x: x != ""))


def variants(normal: Column, depth: int = 3, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """F-14 and F-36 of a normalised string: what up to `depth` rounds of taking one suffix off give, itself included."""
    endings = F.array(*[F.lit(s) for s in suffixes])

    def shorter(x: Column) -> Column:
        cut = F.filter(endings, lambda s: x.endswith(s) & (F.char_length(x) > F.char_length(s)))
        return F.transform(cut, lambda s: F.substring(x, F.lit(1), F.char_length(x) - F.char_length(s)))

    every, last = F.array(normal), F.array(normal)
    for _ in range(depth):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        every = F.concat(every, last)
    return F.filter(F.array_distinct(every), lambda x: x != "")
