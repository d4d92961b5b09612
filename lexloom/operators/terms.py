"""Terms of texts: frequencies, key terms, unknown words and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T

#: A capitalised word inside a text counts for half as much again.
PROPER_BONUS = 1.5
UNKNOWN_SHARE, DOMAIN_SHARE = 0.10, 0.15


def tokens(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, pos, surface, word (normalised): a row a word token, in order by pos.

    Words are normalised in the array, so that what filters them afterwards does not normalise them again.
    """
    made = F.transform(T.words(F.col(text)), lambda w: F.struct(w.alias("surface"), T.normalized_token(w).alias("word")))
    return docs.select(F.col(id_column).alias("id"), F.posexplode(made).alias("pos", "w")).select("id", "pos", "w.surface", "w.word")


def located_tokens(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """F-01: id, pos, surface, offset of each word token; offsets are 0-based code points.

    A text is cut into runs and the gaps before them, and a running sum over its own rows places each run: linear in the text's
    length. Rows that share an id are told apart by a hash of their texts; rows that repeat both must not come.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    runs, gaps = F.regexp_extract_all(c, F.lit(f"({T.WORD['java']})"), F.lit(1)), F.split(c, T.WORD["java"], -1)
    each = docs.select(F.col(id_column).alias("id"), F.xxhash64(c).alias("__tx"), F.posexplode(F.arrays_zip(runs.alias("run"), F.slice(gaps, F.lit(1), F.size(runs)).alias("gap"))).alias("k", "z"))
    own = Window.partitionBy("id", "__tx").orderBy("k")
    placed = each.select("id", "__tx", "k", F.col("z.run").alias("surface"), (F.sum(F.char_length("z.gap") + F.char_length("z.run")).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("z.run")).alias("offset"))
    kept = placed.where(F.col("surface").rlike(T.LATIN["java"]))
    return kept.select("id", (F.row_number().over(own) - 1).alias("pos"), "surface", "offset")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how often each normalised word is in the texts; counted in each task before the shuffle."""
    each = docs.select(F.explode(F.transform(T.words(F.col(text)), T.normalized_token)).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n"))


def corpus_lexicon(docs: DataFrame, floor: float = 0.0, text: str = "text") -> DataFrame:
    """word, n, probability (0 under the floor: censored): what a corpus knows of its words. The total reuses the shuffle of the counts."""
    counts = word_counts(docs, text)
    total = counts.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).select("word", "n", F.when(p >= floor, p).otherwise(0.0).alias("probability"))  # total: one row


def context_tf(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """E-01: id, word, tf, first_pos of the known content words of each text."""
    content = tokens(docs, id_column, text).where(T.is_content(F.col("word")))
    return content.join(known.select("word").distinct(), "word", "left_semi").groupBy("id", "word").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def extract_terms(docs: DataFrame, lexicon: DataFrame, max_terms: int = 20, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Q-05, E-02, E-03: id, nth, word, score, first_pos: each text's terms by their share of its content words, half more for
    proper nouns, times what the lexicon (word, probability) says of them; of equal scores the first seen.

    The share is of all content words, those without a probability included. A capitalised word counts as proper anywhere
    but at the start of the text.
    """
    content = tokens(docs, id_column, text).where(T.is_content(F.col("word")))
    proper = (F.col("pos") > 0) & F.col("surface").rlike(r"^\p{Lu}")
    counts = content.groupBy("id", "word").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"), F.max(proper).alias("proper"))
    counts = counts.withColumn("total", F.sum("tf").over(Window.partitionBy("id")))
    weight = F.col("tf") / F.col("total") * F.when(F.col("proper"), PROPER_BONUS).otherwise(1.0)
    scored = counts.join(lexicon.select("word", S.idf(F.col("probability")).alias("idf")).where("idf is not null"), "word").withColumn("score", weight * F.col("idf"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "first_pos"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= max_terms).select("id", "nth", "word", "score", "first_pos")


def document_terms(docs: DataFrame, lexicon: DataFrame, max_terms: int = 20, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Q-06, W-10: id, nth, word: the terms of each sentence, merged in first-seen order."""
    each = docs.select(F.col(id_column).alias("__doc"), F.posexplode(T.sentences(F.col(text))).alias("__nth", "__sentence"))
    each = each.select(F.struct("__doc", "__nth").alias("__key"), "__sentence")
    found = extract_terms(each, lexicon, max_terms, "__key", "__sentence")
    first = found.groupBy(F.col("id.__doc").alias("id"), "word").agg(F.min(F.struct(F.col("id.__nth").alias("s"), F.col("nth").alias("t"))).alias("first"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("first"))
    return first.withColumn("nth", nth).where(F.col("nth") <= max_terms).select("id", "nth", "word")


def unknown_words(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """E-04: id, unknown, words: distinct normalised words, and those that are not known. Texts without words have no row."""
    each = tokens(docs, id_column, text).where("word <> ''").select("id", "word").distinct()
    marked = each.join(known.select(F.col("word").alias("__k")).distinct(), F.col("word") == F.col("__k"), "left")
    return marked.groupBy("id").agg(F.sum(F.col("__k").isNull().cast("long")).alias("unknown"), F.count("*").alias("words"))


def domain_hits(docs: DataFrame, lexicons: dict[str, str] = S.DOMAINS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, words and, by domain, how many of a text's content words are in its lexicon; texts without any have zeros."""
    content = tokens(docs, id_column, text).where(T.is_content(F.col("word")))
    among = [F.count_if(F.col("word").isin(*dict.fromkeys(w.lower().split()))).alias(name) for name, w in lexicons.items()]
    hits = content.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("words"), *among)
    names = ["words", *lexicons]
    return docs.select(F.col(id_column).alias("id")).join(hits, F.col("id") == F.col("__id"), "left").select("id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def domains(lexicons: dict[str, str] = S.DOMAINS) -> Column:
    """E-05 on the columns of domain_hits(): the domains that at least 15 % of the content words belong to, in the lexicons' order."""
    names = F.array(*[F.when((F.col("words") > 0) & (F.try_divide(F.col(name), F.col("words")) >= DOMAIN_SHARE), F.lit(name)) for name in lexicons])
    return F.filter(names, lambda n: n.isNotNull())


def should_fire(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text: str = "text", lexicons: dict[str, str] = S.DOMAINS) -> DataFrame:
    """C-20: id, fires: English enough, and over a tenth of the words unknown or any domain found."""
    unknown = unknown_words(docs, known, id_column, text).withColumnRenamed("id", "__id")
    found = domain_hits(docs, lexicons, id_column, text).select(F.col("id").alias("__d"), (F.size(domains(lexicons)) > 0).alias("special"))
    heavy = docs.select(F.col(id_column).alias("id"), T.is_english_heavy(F.col(text)).alias("heavy"))
    joined = heavy.join(unknown, F.col("id") == F.col("__id"), "left").join(found, F.col("id") == F.col("__d"))
    share = F.coalesce(F.col("unknown") / F.col("words"), F.lit(0.0))
    return joined.select("id", (F.col("heavy") & ((share > UNKNOWN_SHARE) | F.col("special"))).alias("fires"))
