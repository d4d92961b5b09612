"""The lexicon as tables, and lookups in it.

entries: key, entry_idx, freq_rank and the fields of a record, a row an entry. links: word, rank, pos, gloss, a row for each gloss of a word
in first-seen order. inflections: form, lemmas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T

RECORD = """array<struct<word:string,pronunciation:string,probability:string,translation:array<string>,related:array<string>,
cooccurrence:array<string>,item:array<struct<pos:string,label:string,text:string>>,example:array<struct<e:string,j:string>>,
aoa_base:string,aoa_concept:string,share:string>>"""
#: A probability of 0 is censored and counts as this one on a logarithmic scale.
FLOOR = 1e-7


def with_rank(lines: DataFrame, column: str = "value", order: str | None = None) -> DataFrame:
    """A-08, W-01: key and 0-based freq_rank of a key list, blank lines left out.

    order names a column that gives the list's order; without one it is the order of the file's rows. Done once at ingest.
    """
    kept = lines.where(F.trim(column) != "")
    if order:
        return kept.select(F.col(column).alias("key"), (F.row_number().over(Window.orderBy(order)) - 1).cast("long").alias("freq_rank"))
    indexed = kept.select(column).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    return kept.sparkSession.createDataFrame(indexed, "key string, freq_rank long")


def entries(raw: DataFrame) -> DataFrame:
    """A-11, A-12: raw (key, freq_rank, raw as JSON) as records, a row an entry. Bad JSON gives no row; absent fields are empty.

    Without translations of its own an entry takes those of its senses. pos is the first sense's, unkpos if there is none.
    """
    each = raw.select("key", F.coalesce("freq_rank", F.lit(-1)).alias("freq_rank"), F.posexplode(F.from_json("raw", RECORD)).alias("entry_idx", "e"))
    empty = F.expr("cast(array() as array<string>)")
    items = F.coalesce("e.item", F.expr("cast(array() as array<struct<pos:string,label:string,text:string>>)"))
    filled = lambda c: F.filter(F.coalesce(c, empty), lambda x: x.isNotNull() & (x != ""))
    senses = F.transform(items, lambda i: F.struct(i["pos"].alias("pos"), i["text"].alias("text"), i["label"].alias("label"), T.sense_translations(i["text"]).alias("translations")))
    prob = T.probability(F.col("e.probability"))
    base = each.select(
        "key", "freq_rank", "entry_idx", F.coalesce("e.word", "key").alias("word"), prob.alias("prob"), F.when(prob > 0, F.log10(prob)).otherwise(F.lit(-7.0)).alias("log_freq"), (prob <= 0).alias("probability_floor"),
        filled(F.col("e.translation")).alias("own"), senses.alias("senses"), filled(F.col("e.related")).alias("related"), filled(F.col("e.cooccurrence")).alias("cooccurrence"),
        F.coalesce("e.example", F.expr("cast(array() as array<struct<e:string,j:string>>)")).alias("examples"), F.coalesce("e.pronunciation", F.lit("")).alias("pronunciation"),
    )
    tags = F.array_distinct(F.filter(F.transform("senses", lambda s: s["pos"]), lambda x: x.isNotNull() & (x != "")))
    of_senses = F.array_distinct(F.flatten(F.transform("senses", lambda s: s["translations"])))
    return base.withColumns({"pos_list": tags, "n_senses": F.size("senses"), "translations": F.when(F.size("own") > 0, F.col("own")).otherwise(of_senses)}).withColumn("pos", F.coalesce(F.try_element_at("pos_list", F.lit(1)), F.lit("unkpos")))


def links(records: DataFrame) -> DataFrame:
    """J-06: word (the key), rank, pos, gloss: every translation of a key over its entries and their senses, once, in first-seen order."""
    all_of = F.concat("own", F.flatten(F.transform("senses", lambda s: s["translations"])))
    each = records.select(F.col("key").alias("word"), F.col("freq_rank").alias("rank"), "entry_idx", F.posexplode(all_of).alias("at", "gloss"))
    first = each.groupBy("word", "rank", "gloss").agg(F.min(F.struct("entry_idx", "at")).alias("first"))
    return first.select("word", "rank", (F.row_number().over(Window.partitionBy("word").orderBy("first")) - 1).alias("pos"), "gloss")


def lookup(words: DataFrame, records: DataFrame, inflections: DataFrame) -> DataFrame:
    """J-01, J-03: words (word; other columns stay) with the entries of the key, else of the first lemma that is a key, else nulls.

    lemma: the key that was found; via_lemma: whether through an inflection. Both joins are on equal keys, and Spark picks their kind by size.
    """
    keys = records.select(F.col("key").alias("__key")).distinct()
    asked = words.withColumn("__norm", T.normalized(F.col("word")))
    exact = asked.join(keys, F.col("__norm") == F.col("__key"), "left")
    lemmas = inflections.select(F.col("form").alias("__form"), F.posexplode("lemmas").alias("__at", "__lemma")).withColumn("__lemma", T.normalized(F.col("__lemma")))
    first = lemmas.join(keys, F.col("__lemma") == F.col("__key"), "left_semi").groupBy("__form").agg(F.min_by("__lemma", "__at").alias("__lemma"))
    found = exact.join(first, F.col("__key").isNull() & (F.col("__norm") == F.col("__form")), "left")
    found = found.withColumn("lemma", F.coalesce("__key", "__lemma")).withColumn("via_lemma", F.col("__key").isNull() & F.col("__lemma").isNotNull())
    return found.drop("__norm", "__key", "__form", "__lemma").join(records, F.col("lemma") == F.col("key"), "left")


def sidecar_lookup(words: DataFrame, records: DataFrame, inflections: DataFrame) -> DataFrame:
    """J-04, Q-01: asked, word, found, pronunciation, translations, related, probability, lemmas: the first entry, a row a word asked for.

    lemmas is filled only where the word itself is no key: its lemmas, or the word where it has none. Unknown words keep their own spelling.
    """
    first = lookup(words.select("word").distinct(), records.where("entry_idx = 0").withColumnRenamed("word", "headword"), inflections)
    of = inflections.select(F.col("form").alias("__form"), F.col("lemmas").alias("__lemmas"))
    joined = first.join(of, T.normalized(F.col("word")) == F.col("__form"), "left")
    found, empty = F.col("lemma").isNotNull(), F.expr("cast(array() as array<string>)")
    direct = found & ~F.col("via_lemma")
    return joined.select(
        F.col("word").alias("asked"), F.coalesce("headword", "word").alias("word"), found.alias("found"), F.coalesce("pronunciation", F.lit("")).alias("pronunciation"), F.coalesce("own", empty).alias("translations"), F.coalesce("related", empty).alias("related"),
        F.coalesce("prob", F.lit(0.0)).alias("probability"), F.when(direct, empty).otherwise(F.coalesce("__lemmas", F.array("word"))).alias("lemmas"),
    )


def exists(words: DataFrame, records: DataFrame) -> DataFrame:
    """J-02: the words that are keys once normalised."""
    return words.join(records.select(F.col("key").alias("__key")).distinct(), T.normalized(F.col("word")) == F.col("__key"), "left_semi")


def reverse(glosses: DataFrame, all_links: DataFrame, capacity: int) -> DataFrame:
    """J-05: gloss, nth, word: the headwords of each gloss by rank, `capacity` at most. Each task keeps a gloss's first ones only, before the shuffle."""
    met = all_links.join(glosses.select("gloss").distinct(), "gloss", "left_semi")
    nth = F.row_number().over(Window.partitionBy("gloss").orderBy("rank", "word"))
    return met.withColumn("nth", nth).where(F.col("nth") <= capacity).select("gloss", "nth", "word")


def synonyms(all_links: DataFrame, gloss_limit: int = 8, per_gloss: int = 4, limit: int = 12) -> DataFrame:
    """J-07: word, nth, synonym: the headwords that share one of a word's first glosses, in first-seen order, without the word itself."""
    seeds = all_links.where(F.col("pos") < gloss_limit).select("word", "pos", "gloss")
    hits = reverse(all_links, all_links, per_gloss).select(F.col("gloss").alias("__g"), F.col("nth").alias("__n"), F.col("word").alias("synonym"))
    met = seeds.join(hits, F.col("gloss") == F.col("__g")).where(F.lower("synonym") != F.lower("word"))
    first = met.groupBy("word", "synonym").agg(F.min(F.struct("pos", "__n")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("word").orderBy("first"))
    return first.withColumn("nth", nth).where(F.col("nth") <= limit).select("word", "nth", "synonym")


def expand_glosses(all_links: DataFrame, synonym_limit: int = 12, per_synonym: int = 40, extra_limit: int = 200, **limits) -> DataFrame:
    """J-08: word, nth, gloss, extra: a word's own glosses, all of them, then new ones of its synonyms, `extra_limit` at most."""
    own = all_links.select("word", F.lit(0).alias("a"), F.col("pos").alias("b"), "gloss")
    theirs = all_links.where(F.col("pos") < per_synonym).select(F.col("word").alias("__w"), F.col("pos").alias("b"), "gloss")
    met = synonyms(all_links, limit=synonym_limit, **limits).join(theirs, F.col("synonym") == F.col("__w")).select("word", F.col("nth").alias("a"), "b", "gloss")
    first = own.unionByName(met).groupBy("word", "gloss").agg(F.min(F.struct("a", "b")).alias("first"))
    new = first.withColumn("extra", F.col("first.a") > 0)
    nth = F.row_number().over(Window.partitionBy("word", "extra").orderBy("first"))
    kept = new.withColumn("n", nth).where(~F.col("extra") | (F.col("n") <= extra_limit))
    return kept.select("word", (F.row_number().over(Window.partitionBy("word").orderBy("first"))).alias("nth"), "gloss", "extra")


def phrases(asked: DataFrame, records: DataFrame) -> DataFrame:
    """J-09, U6 (own definition): asked (core, prefix, suffix) with the keys of several words that hold the core as a word.

    Keys are narrowed by a normalised prefix before and suffix after the core where those are given; in the list's order. Keys meet the core on
    equal words, not by comparing all with all.
    """
    keys = records.select("key", "freq_rank").distinct().withColumn("__words", F.split("key", "[ -]"))
    each = keys.where(F.size("__words") > 1).withColumn("__w", F.explode(F.array_distinct("__words")))
    norm = asked.withColumn("__core", T.normalized(F.col("core")))
    found = norm.join(each, F.col("__core") == F.col("__w"))
    before, after = T.normalized(F.coalesce("prefix", F.lit(""))), T.normalized(F.coalesce("suffix", F.lit("")))
    fits = F.col("key").contains(F.concat(before, F.when(before != "", F.lit(" ")).otherwise(""), F.col("__core"), F.when(after != "", F.lit(" ")).otherwise(""), after))
    return found.where(fits).drop("__core", "__words", "__w")


def raw_json(words: DataFrame, raw: DataFrame) -> DataFrame:
    """A-19: words (word; other columns stay) with the stored JSON of their key; null for words that are no key."""
    stored = raw.select(F.col("key").alias("__key"), "raw")
    return words.join(stored, T.normalized(F.col("word")) == F.col("__key"), "left").drop("__key")


def compact(records: DataFrame, limit: int | None = None) -> DataFrame:
    """B-05: key, entry_idx and the entry as short JSON: 20 translations and 10 related words, or `limit` of each; no pronunciation if there is none."""
    spoken = F.when(F.col("pronunciation") != "", F.col("pronunciation"))
    entry = F.struct("word", F.slice("own", 1, limit or 20).alias("translation"), F.slice("related", 1, limit or 10).alias("related"), spoken.alias("pronunciation"), F.col("prob").alias("probability"))
    return records.select("key", "entry_idx", F.to_json(entry).alias("json"))


FIELDS = ("key", "word", "freq_rank", "prob", "log_freq", "pos", "pos_list", "n_senses", "translations", "senses", "examples", "related", "cooccurrence", "domain", "pronunciation", "probability_floor")


def as_json(records: DataFrame) -> DataFrame:
    """B-15: key, entry_idx, n_examples and the whole record as JSON; the domain is worked out where records have none."""
    own = records if "domain" in records.columns else records.withColumn("domain", S.domain(F.col("word"), F.col("senses")))
    return own.select("key", "entry_idx", F.size("examples").alias("n_examples"), F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("json"))
