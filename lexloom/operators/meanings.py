"""Meanings of words in context: context features, ranked meanings, enrichment and hint blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from .lexicon import lookup
from .terms import context_tf, tokens

#: Words of a context, words that expand it, related words of each, and their weight.
MOST_WORDS, SEEDS, OF_SEED, EXPANDED = 64, 8, 8, 0.5
EMPTY = "cast(map() as map<string,double>)"


def scored_records(records: DataFrame, lexicons: dict[str, str] = S.DOMAINS) -> DataFrame:
    """Records with what scoring needs of an entry, computed once (E-19): features, evidence, sense vectors, domain."""
    return records.withColumns({"features": S.entry_features(F.col("word"), F.col("related"), F.col("cooccurrence")), "evidence": S.evidence(F.col("related"), F.col("cooccurrence")), "sense_vectors": S.sense_vectors(F.col("senses")), "domain": S.domain(F.col("word"), F.col("senses"), lexicons)})


def context_features(contexts: DataFrame, records: DataFrame, excluded: DataFrame) -> DataFrame:
    """Q-02: contexts (id, context) to (id, features): counts of known content words, and related words of the first eight
    that are not excluded (id, word), at half weight. Contexts without known words have no row.

    At 64 words the expansion stops; a context that has as many of its own still gets the very first related word if it is new.
    """
    known = records.select(F.col("key").alias("word"))
    base = context_tf(contexts, known, "id", "context")
    sized = base.withColumn("n", F.count("*").over(Window.partitionBy("id")))
    left = sized.join(excluded.select(F.col("id").alias("__i"), F.col("word").alias("__w")).distinct(), (F.col("id") == F.col("__i")) & (F.col("word") == F.col("__w")), "left_anti")
    seeds = left.withColumn("seed", F.row_number().over(Window.partitionBy("id").orderBy("first_pos"))).where(F.col("seed") <= SEEDS)
    related = records.where("entry_idx = 0").select(F.col("key").alias("__k"), F.slice("related", 1, OF_SEED).alias("__r"))
    each = seeds.join(related, F.col("word") == F.col("__k")).select("id", "n", "seed", F.posexplode("__r").alias("at", "r")).withColumn("new", T.fast_normalized(F.col("r")))
    each = each.withColumn("examined", F.row_number().over(Window.partitionBy("id").orderBy("seed", "at")))
    own = base.select(F.col("id").alias("__i"), F.col("word").alias("__w"))
    first = each.where("new <> ''").join(own, (F.col("id") == F.col("__i")) & (F.col("new") == F.col("__w")), "left_anti").groupBy("id", "new").agg(F.min("examined").alias("examined"), F.first("n").alias("n"))
    kth = F.row_number().over(Window.partitionBy("id").orderBy("examined"))
    added = first.withColumn("kth", kth).where(F.when(F.col("n") < MOST_WORDS, F.col("kth") <= MOST_WORDS - F.col("n")).otherwise(F.col("examined") == 1))
    every = base.select("id", "word", F.col("tf").cast("double").alias("weight")).unionByName(added.select("id", F.col("new").alias("word"), F.lit(EXPANDED).alias("weight")))
    return every.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "weight")))).alias("features"))


def rank_meanings(candidates: DataFrame, max_meanings: int = 8) -> DataFrame:
    """F-22 to F-25, W-06 to W-08: candidates (id and a scored record's columns, `context`) to id, nth, ja, domain, score, word.

    Entries go by score, an entry's translations by weight, and the first `max_meanings` of all count.
    """
    score = S.entry_score(F.col("prob"), F.col("evidence"), F.col("features"), F.col("context"))
    ranked = candidates.withColumn("__score", score).withColumn("__rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("__score"), "entry_idx"))).where(F.col("__rank") <= max(1, max_meanings))
    each = ranked.select("id", "__rank", "__score", "word", "domain", F.posexplode(S.ranked_translations(F.col("own"), F.col("sense_vectors"), F.col("context"), max_meanings)).alias("__at", "m"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("__rank", "__at"))
    final = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__score") * F.col("m.weight"))), 4)
    return each.withColumn("nth", nth).where(F.col("nth") <= max_meanings).select("id", "nth", F.col("m.ja").alias("ja"), "domain", final.alias("score"), "word")


def resolve(asked: DataFrame, scored: DataFrame, inflections: DataFrame, max_meanings: int = 8) -> DataFrame:
    """Q-03: asked (id, word, context) to the meanings of each word in its context, as rank_meanings() gives them. Unknown words give no row.

    The word and its lemmas do not expand the context.
    """
    lemmas = inflections.select(F.col("form").alias("__form"), F.explode("lemmas").alias("__lemma"))
    own = asked.select("id", T.normalized(F.col("word")).alias("word"))
    excluded = own.unionByName(own.join(lemmas, F.col("word") == F.col("__form")).select("id", T.normalized(F.col("__lemma")).alias("word")))
    features = context_features(asked.select("id", "context"), scored, excluded).select(F.col("id").alias("__id"), F.col("features").alias("context"))
    found = lookup(asked.select("id", F.col("word").alias("word")), scored.withColumnRenamed("word", "headword"), inflections).where("lemma is not null").drop("word").withColumnRenamed("headword", "word")
    joined = found.join(features, F.col("id") == F.col("__id"), "left").withColumn("context", F.coalesce("context", F.expr(EMPTY)))
    return rank_meanings(joined, max_meanings)


def enrich(texts: DataFrame, scored: DataFrame, inflections: DataFrame, max_terms: int = 20, max_meanings: int = 8) -> DataFrame:
    """Q-04, W-12: texts (id, text) to id, term, word, nth, ja, domain, score: the meanings of each text's dictionary words.

    A text's first `max_terms` distinct words that are no stop words and in the lexicon (or inflected forms of its keys) are its terms,
    also those that turn out to have no meaning; one context serves them all, which none of them expands. Words are single tokens (own definition).
    """
    seen = tokens(texts, "id", "text").where(~T.is_stop_word(F.col("surface"))).groupBy("id", "surface").agg(F.min("pos").alias("pos"))
    keys = lookup(seen.withColumnRenamed("surface", "word"), scored.where("entry_idx = 0").select("key"), inflections).where("lemma is not null").select("id", F.col("word").alias("surface"), "pos", "lemma")
    terms = keys.withColumn("term", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("term") <= max_terms)
    excluded = terms.select("id", T.normalized(F.col("surface")).alias("word"))
    features = context_features(texts.select("id", F.col("text").alias("context")), scored, excluded).select(F.col("id").alias("__id"), F.col("features").alias("context"))
    joined = terms.join(scored, F.col("lemma") == F.col("key")).join(features, F.col("id") == F.col("__id"), "left").withColumn("context", F.coalesce("context", F.expr(EMPTY)))
    found = rank_meanings(joined.withColumn("id", F.struct("id", "term", "surface")), max_meanings)
    return found.select(F.col("id.id").alias("id"), F.col("id.term").alias("term"), F.col("id.surface").alias("word"), "nth", "ja", "domain", "score")


def rendered(ja: Column, domain: Column) -> Column:
    """F-27."""
    return F.when(F.coalesce(domain, F.lit("")) != "", F.concat(ja, F.lit("（"), domain, F.lit("）"))).otherwise(ja)


def hints(enriched: DataFrame, max_candidates: int = 8) -> DataFrame:
    """B-03: id, hints: the block of candidate meanings of each text, a line a meaning under its word."""
    lines = enriched.where(F.col("nth") <= max_candidates).groupBy("id", "term", "word").agg(F.sort_array(F.collect_list(F.struct("nth", F.concat(F.lit("- "), rendered(F.col("ja"), F.col("domain"))).alias("line")))).alias("all"))
    part = F.concat_ws("\n", F.concat("word", F.lit(":")), F.col("all.line"))
    return lines.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", part.alias("part")))).alias("parts")).select("id", F.concat_ws("\n", F.lit("[参考語彙]"), F.col("parts.part")).alias("hints"))


def tool_answer(arguments: DataFrame, scored: DataFrame, inflections: DataFrame) -> DataFrame:
    """Q-08, C-23: arguments (id, text, word, max_terms) to (id, answer as JSON): of a word its rendered candidates, else the text's terms.

    max_terms is clamped to 1 to 100, 20 if it is no number; a null text or one over 20,000 characters gives an error message.
    """
    n = F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce(F.col("max_terms").try_cast("int"), F.lit(20))))
    asked = arguments.withColumn("__n", n)
    words = asked.where("coalesce(word, '') <> ''").select("id", "word", F.coalesce("text", F.lit("")).alias("context"))
    one = resolve(words, scored, inflections, 100).join(asked.select(F.col("id").alias("__id"), "__n"), F.col("id") == F.col("__id")).where("nth <= __n")
    one = one.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", rendered(F.col("ja"), F.col("domain")).alias("c")))), lambda x: x["c"]).alias("candidates")).select("id", F.to_json(F.struct("candidates")).alias("a"))
    texts = asked.where("coalesce(word, '') = '' and text is not null and char_length(text) <= 20000").select("id", "text")
    many = enrich(texts, scored, inflections, 100).join(asked.select(F.col("id").alias("__id"), "__n"), F.col("id") == F.col("__id")).where("term <= __n")
    per = many.groupBy("id", "term", "word").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "ja"))), lambda x: x["ja"]).alias("candidates"))
    per = per.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("term", "word", "candidates"))), lambda x: F.struct(x["word"].alias("word"), x["candidates"].alias("candidates"))).alias("terms")).select("id", F.to_json(F.struct("terms")).alias("a"))
    every = asked.join(one.unionByName(per).withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    missing = F.when((F.coalesce("word", F.lit("")) == "") & F.col("text").isNull(), '{"error":"text is required"}').when((F.coalesce("word", F.lit("")) == "") & (F.char_length("text") > 20000), '{"error":"text is too long"}').otherwise('{"message":"no entries"}')
    return every.select("id", F.coalesce("a", missing).alias("answer"))
