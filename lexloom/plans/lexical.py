"""Queries on key lists, the lexicon and meanings."""

from __future__ import annotations

import json


from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import lexicon as L
from ..operators import meanings as M
from ..operators import search as K
from ..operators import terms
from . import fixtures as V
from .texts import LEX, norm_sql, read, strip_sql

# Key lists


def corpus_keys(spark, sf):
    """word, n, freq_rank of the corpus: the most frequent first, of equal ones by word."""
    words = terms.corpus_lexicon(read(spark, sf, "documents")).select("word", "n")
    return words.withColumn("order", F.struct((-F.col("n")).alias("n"), "word"))


def a08(spark, sf):
    ranked = L.with_rank(corpus_keys(spark, sf), "word", "order")
    return ranked


A08 = f"WITH {LEX} SELECT word AS key, row_number() OVER (ORDER BY n DESC, word COLLATE C) - 1 AS freq_rank FROM lex".replace(" COLLATE C", "")

MODES = {
    "c01_contain": ("contain", "thth", "contains(key, 'thth')"),
    "c02_begin": ("begin", "the", "starts_with(key, 'the')"),
    "c03_end": ("end", "tion", "ends_with(key, 'tion')"),
    "c04_containcase": ("containcase", "ThTh", "contains(translate(key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'thth')"),
    "c05_containword": ("containword", "a", "regexp_matches(key, '(^|[^0-9A-Za-z])a($|[^0-9A-Za-z])')"),
    "c06_containcaseword": ("containcaseword", "DE", "regexp_matches(translate(key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^0-9A-Za-z])de($|[^0-9A-Za-z])')"),
    "c07_batch_contain": ("contain*", "thth\n\nedble", "(contains(key, 'thth') OR contains(key, 'edble'))"),
    "c08_batch_containcase": ("containcase*", "THTH\nEdble", "(contains(key, 'thth') OR contains(key, 'edble'))"),
    "c09_batch_containword": ("containword*", "de\nla", "regexp_matches(key, '(^|[^0-9A-Za-z])(de|la)($|[^0-9A-Za-z])')"),
    "c10_batch_containcaseword": ("containcaseword*", "DE\nLa", "regexp_matches(key, '(^|[^0-9A-Za-z])(de|la)($|[^0-9A-Za-z])')"),
    "c11_regex": ("regex", "^(th|ed)+$", "regexp_matches(key, '^(th|ed)+$')"),
}


def search(mode: str, pattern: str):
    """Over the words of the corpus and the urls of pages."""

    def run(spark, sf):
        words = corpus_keys(spark, sf).select(F.col("word").alias("key"))
        return K.search(words.unionByName(read(spark, sf, "pages").select(F.col("url").alias("key")).distinct()), mode, pattern, 0, "key", "key")

    return run


def search_sql(condition: str) -> str:
    return f"WITH {LEX}, k AS (SELECT word AS key FROM lex UNION ALL SELECT DISTINCT url FROM pages) SELECT key FROM k WHERE {condition}"


def w09(spark, sf):
    return K.search(read(spark, sf, "customer").select(F.col("c_name").alias("key")), "edit", "Customer#000000107", 25, "key")


W09 = "SELECT c_name AS key, levenshtein(c_name, 'Customer#000000107') AS dist FROM customer ORDER BY dist, key LIMIT 25"

# The gloss graph of the part table: a word is a part's name, a gloss its brand and size


def part_links(spark, sf):
    part = read(spark, sf, "part").select(F.col("p_name").alias("word"), F.col("p_partkey").alias("k"), F.concat("p_brand", F.lit("#"), F.col("p_size").cast("string")).alias("gloss"))
    first = part.groupBy("word", "gloss").agg(F.min("k").alias("k"))
    from pyspark.sql import Window

    ranks = part.groupBy("word").agg(F.min("k").alias("rank"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("word").orderBy("k")) - 1).join(ranks, "word").select("word", "rank", "pos", "gloss")


LINKS = """links AS (SELECT word, min(k) OVER (PARTITION BY word) AS rank, row_number() OVER (PARTITION BY word ORDER BY k) - 1 AS pos, gloss
 FROM (SELECT p_name AS word, p_brand || '#' || p_size::text AS gloss, min(p_partkey) AS k FROM part GROUP BY ALL))"""
SYN = f"""{LINKS}, rev AS (SELECT gloss, row_number() OVER (PARTITION BY gloss ORDER BY rank, word) AS nth, word FROM links QUALIFY nth <= 4),
 syn AS (SELECT word, row_number() OVER (PARTITION BY word ORDER BY first) AS nth, synonym FROM (
  SELECT l.word, r.word AS synonym, min(l.pos * 10 + r.nth) AS first FROM links l JOIN rev r USING (gloss) WHERE l.pos < 8 AND lower(l.word) <> lower(r.word) GROUP BY ALL) QUALIFY nth <= 12)"""


def j05(spark, sf):
    links = part_links(spark, sf)
    return L.reverse(links, links, 4)


def j06(spark, sf):
    return part_links(spark, sf)


def j07(spark, sf):
    return L.synonyms(part_links(spark, sf))


def j08(spark, sf):
    return L.expand_glosses(part_links(spark, sf))


J08 = f"""WITH {SYN}, f AS (SELECT word, gloss, min(a * 1000000 + b) AS first FROM (
  SELECT word, 0 AS a, pos AS b, gloss FROM links UNION ALL SELECT s.word, s.nth, l.pos, l.gloss FROM syn s JOIN links l ON l.word = s.synonym WHERE l.pos < 40) GROUP BY ALL),
 e AS (SELECT *, first >= 1000000 AS extra FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY word, extra ORDER BY first) AS k FROM e)
SELECT word, row_number() OVER (PARTITION BY word ORDER BY first) AS nth, gloss, extra FROM n WHERE NOT extra OR k <= 200"""

# The fixture lexicon


def records(spark):
    return L.entries(V.raw_lexicon(spark))


def _number(x) -> float:
    try:
        return float(x)
    except ValueError:
        return 0.0


_ROWS = [(k, r, i, e["word"], _number(e["probability"]), e["translation"], [t["text"] for t in e["item"]], e["item"][0]["pos"] if e["item"] else "unkpos", len(e["item"]), e["related"], e["cooccurrence"], e.get("pronunciation") or "") for r, (k, es) in enumerate(V.LEXICON) for i, e in enumerate(es)]
_OF_TEXT = f"list_filter(list_transform(string_split(regexp_replace(list_extract(string_split(t, '[translation]:'), 2), '\\[(-|synonym|note)\\].*$', ''), ','), lambda x: {strip_sql('x')}), lambda x: x <> '')"
REC = V.values("rec", "key, freq_rank, entry_idx, word, prob, own, texts, pos, n_senses, related, cooccurrence, pronunciation", _ROWS)
REC_TR = f"""{REC}, senses AS (SELECT key, entry_idx, k, {_OF_TEXT} AS tr FROM (SELECT key, entry_idx, unnest(texts) AS t, generate_subscripts(texts, 1) AS k FROM rec)),
 each AS (SELECT key, entry_idx, 0 AS k, unnest(own) AS gloss, generate_subscripts(own, 1) AS pl FROM rec UNION ALL SELECT key, entry_idx, k, unnest(tr), generate_subscripts(tr, 1) FROM senses)"""


def a11(spark, sf):
    r = records(spark)
    return r.select("key", "freq_rank", "entry_idx", "word", "prob", F.round("log_freq", 6).alias("log_freq"), "probability_floor", "pos", F.col("n_senses").cast("long").alias("n_senses"), F.concat_ws("|", "translations").alias("translations"), "pronunciation")


A11 = f"""WITH {REC_TR}, st AS (SELECT key, entry_idx, string_agg(gloss, '|' ORDER BY k, pl) AS s FROM (SELECT key, entry_idx, gloss, min(k) AS k, min(pl) AS pl FROM each WHERE k > 0 GROUP BY ALL) GROUP BY ALL)
SELECT key, freq_rank, entry_idx, word, prob, CASE WHEN prob > 0 THEN round(log10(prob), 6) ELSE -7.0 END AS log_freq, prob <= 0 AS probability_floor, pos, n_senses, CASE WHEN len(own) > 0 THEN array_to_string(own, '|') ELSE coalesce(s, '') END AS translations, pronunciation
FROM rec LEFT JOIN st USING (key, entry_idx)"""


def j06_fixture(spark, sf):
    return L.links(records(spark)).select("word", "pos", "gloss")


J06F = f"WITH {REC_TR} SELECT key AS word, row_number() OVER (PARTITION BY key ORDER BY first) - 1 AS pos, gloss FROM (SELECT key, gloss, min(entry_idx * 10000 + k * 100 + pl) AS first FROM each GROUP BY ALL)"
ASKED = V.values("asked", "word", [(w,) for w in V.WORDS])
INF = V.values("inf", "form, lemmas", V.INFLECTIONS)
FOUND = f"""{REC}, {ASKED}, {INF}, a AS (SELECT word, {norm_sql('word')} AS norm FROM asked),
 lem AS (SELECT form, arg_min(lemma, pl) AS lemma FROM (SELECT form, unnest(lemmas) AS lemma, generate_subscripts(lemmas, 1) AS pl FROM inf) WHERE lemma IN (SELECT key FROM rec) GROUP BY form),
 fd AS (SELECT a.word, a.norm, CASE WHEN norm IN (SELECT key FROM rec) THEN norm ELSE lem.lemma END AS lemma, norm NOT IN (SELECT key FROM rec) AND lem.lemma IS NOT NULL AS via_lemma FROM a LEFT JOIN lem ON lem.form = a.norm)"""


def asked(spark):
    return spark.createDataFrame([(w,) for w in V.WORDS], "word string")


def j01(spark, sf):
    found = L.lookup(asked(spark), records(spark).withColumnRenamed("word", "headword"), V.inflections(spark))
    return found.select("word", "lemma", "via_lemma", "entry_idx", "headword")


J01 = f"WITH {FOUND} SELECT fd.word, lemma, via_lemma, entry_idx, rec.word AS headword FROM fd LEFT JOIN rec ON rec.key = fd.lemma"


def j04(spark, sf):
    out = L.sidecar_lookup(asked(spark), records(spark), V.inflections(spark))
    return out.withColumns({c: F.concat_ws("|", c) for c in ("translations", "related", "lemmas")})


J04 = f"""WITH {FOUND} SELECT fd.word AS asked, coalesce(rec.word, fd.word) AS word, lemma IS NOT NULL AS found, coalesce(pronunciation, '') AS pronunciation, coalesce(array_to_string(own, '|'), '') AS translations, coalesce(array_to_string(related, '|'), '') AS related, coalesce(prob, 0.0) AS probability,
 CASE WHEN lemma IS NOT NULL AND NOT via_lemma THEN '' ELSE coalesce(array_to_string(inf.lemmas, '|'), fd.word) END AS lemmas
FROM fd LEFT JOIN rec ON rec.key = fd.lemma AND rec.entry_idx = 0 LEFT JOIN inf ON inf.form = fd.norm"""


def f17(spark, sf):
    return records(spark).select("key", "entry_idx", F.round(S.base_frequency(F.col("prob")), 6).alias("base_frequency"), F.round(S.idf(F.col("prob")), 6).alias("idf"))


F17 = f"WITH {REC} SELECT key, entry_idx, CASE WHEN prob > 0 THEN round(greatest(0.0, least(1.0, (log10(prob) + 7) / 5)), 6) ELSE 0.0 END AS base_frequency, CASE WHEN prob > 0 THEN round(greatest(0.0, least(1.0, (log10(prob) + 7) / 2)), 6) END AS idf FROM rec"
CONTEXT = ["river", "shore", "money", "policy", "loan", "c3"]


def f18(spark, sf):
    own = S.evidence(F.col("related"), F.col("cooccurrence"))
    return records(spark).select("key", "entry_idx", F.round(S.domain_match(own, F.array(*map(F.lit, CONTEXT))), 6).alias("domain_match"))


F18 = f"""WITH {REC}, n AS (SELECT key, entry_idx, len(list_intersect(list_transform(list_concat(cooccurrence[1:24], related[1:24]), lambda w: lower(w)), {V.literal(CONTEXT)})) AS n FROM rec)
SELECT key, entry_idx, CASE WHEN n > 0 THEN round(least(1.0::double, 0.4::double * n + 0.2::double), 6) ELSE 0.0::double END AS domain_match FROM n"""


def f19(spark, sf):
    r = records(spark)
    return r.select("key", "entry_idx", F.explode(S.entry_features(F.col("word"), F.col("related"), F.col("cooccurrence"))).alias("word", "weight")).withColumn("weight", F.round("weight", 6))


F19 = f"""WITH {REC}, w AS (SELECT key, entry_idx, lower(unnest(l)) AS word, generate_subscripts(l, 1) AS pl FROM (SELECT key, entry_idx, list_concat([word], related[1:16], cooccurrence[1:20]) AS l FROM rec)),
 f AS (SELECT key, entry_idx, word, min(pl) AS pl FROM w GROUP BY ALL)
SELECT key, entry_idx, word, round(pow(0.95, row_number() OVER (PARTITION BY key, entry_idx ORDER BY pl) - 1), 6) AS weight FROM f"""


def f20(spark, sf):
    """Each vector with the one of the next id."""
    a = read(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(S.dense_cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


F20 = "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def e06(spark, sf):
    return records(spark).select("key", "entry_idx", S.domain(F.col("word"), F.col("senses")).alias("domain"))


def _e06() -> str:
    points = ", ".join(f"""{{'p': CASE WHEN lower(word) IN ({ws}) THEN 3 ELSE 0 END + len(list_filter(flatten(list_transform(texts, lambda t: regexp_extract_all(lower(t), '[a-z]+'))), lambda w: w IN ({ws}))), 'name': '{n}'}}""" for n, x in S.DOMAINS.items() for ws in [", ".join(map(V.literal, x.split()))])
    label = " ".join(f"WHEN '{n}' THEN '{x}'" for n, x in S.LABELS.items())
    return f"WITH {REC}, s AS (SELECT key, entry_idx, list_max([{points}]) AS b FROM rec) SELECT key, entry_idx, CASE WHEN b.p >= 2 THEN CASE b.name {label} END ELSE '一般' END AS domain FROM s"


def contexts(spark):
    return spark.createDataFrame(V.CONTEXTS, "id long, word string, context string")


def q02(spark, sf):
    c = contexts(spark)
    out = M.context_features(c.select("id", "context"), records(spark), c.select("id", T.normalized(F.col("word")).alias("word")))
    return out.select("id", F.explode("features").alias("word", "weight"))




def q03(spark, sf):
    return M.resolve(contexts(spark), M.scored_records(records(spark)), V.inflections(spark))


def fixture_texts(spark):
    return spark.createDataFrame(V.TEXTS, "id long, text string")


def q04(spark, sf):
    return M.enrich(fixture_texts(spark), M.scored_records(records(spark)), V.inflections(spark))


def b03(spark, sf):
    return M.hints(q04(spark, sf))


def q08(spark, sf):
    rows = [(1, "The bank by the river.", None, "3"), (2, "The loan and the money.", "bank", "2"), (3, None, None, None), (4, "x" * 20001, None, "5"), (5, "nothing known here", None, "many")]
    return M.tool_answer(spark.createDataFrame(rows, "id long, text string, word string, max_terms string"), M.scored_records(records(spark)), V.inflections(spark))


def j09(spark, sf):
    """Keys of two words from the corpus that hold frequent words."""
    pairs = read(spark, sf, "benchmark").select(F.explode(F.split("text", "[.!?\n]")).alias("s")).select(F.lower(F.trim("s")).alias("key"))
    keys = pairs.where("key <> ''").distinct().withColumn("freq_rank", F.xxhash64("key"))
    asked_for = spark.createDataFrame([("the", None, None), ("of", None, "the"), ("and", None, None)], "core string, prefix string, suffix string")
    return L.phrases(asked_for, keys).select("core", "suffix", "key")


J09 = """WITH k AS (SELECT DISTINCT lower(trim(s)) AS key FROM (SELECT unnest(string_split_regex(text, '[.!?\\n]')) AS s FROM benchmark) WHERE trim(s) <> ''),
 a(core, suffix) AS (VALUES ('the', NULL), ('of', 'the'), ('and', NULL)), w AS (SELECT key, string_split_regex(key, '[ -]') AS ws FROM k)
SELECT core, suffix, key FROM w JOIN a ON list_contains(ws, core) WHERE len(ws) > 1 AND contains(key, core || coalesce(' ' || suffix, ''))"""



def words(spark):
    return spark.createDataFrame([(w,) for w in V.WORDS], "word string")


def a19(spark, sf):
    return L.raw_json(words(spark), V.raw_lexicon(spark)).select("word", "raw")


A19 = f"""WITH {V.values('w', 'word', [(w,) for w in V.WORDS])}, {V.values('r', 'key, raw', [(k, json.dumps(e, ensure_ascii=False)) for k, e in V.LEXICON])}
SELECT word, raw FROM w LEFT JOIN r ON key = trim(lower(word))"""


def b05(spark, sf):
    """The compact JSON read again."""
    e = F.from_json("json", "word string, translation array<string>, related array<string>, pronunciation string, probability double").alias("e")
    return L.compact(records(spark), 2).select("key", "entry_idx", e).select("key", "entry_idx", "e.word", F.array_join("e.translation", "|").alias("translation"), F.array_join("e.related", "|").alias("related"), "e.pronunciation", "e.probability")


B05 = f"""WITH {REC} SELECT key, entry_idx, word, array_to_string(own[1:2], '|') AS translation, array_to_string(related[1:2], '|') AS related, nullif(pronunciation, '') AS pronunciation, prob::double AS probability FROM rec"""


def b15(spark, sf):
    """The record's JSON read again."""
    j = L.as_json(records(spark))
    return j.select("key", "entry_idx", F.array_join(F.json_object_keys("json"), " ").alias("fields"), F.get_json_object("json", "$.n_senses").cast("int").alias("n_senses"), F.json_array_length(F.get_json_object("json", "$.related")).alias("n_related"), F.get_json_object("json", "$.domain").alias("domain"))


def _b15() -> str:
    return f"WITH d AS ({_e06()}), r AS (WITH {REC} SELECT * FROM rec) SELECT key, entry_idx, '{' '.join(L.FIELDS)}' AS fields, n_senses::int AS n_senses, len(related)::int AS n_related, domain FROM r JOIN d USING (key, entry_idx)"


QUERIES = {"a08_freq_rank": a08, **{n: search(m, p) for n, (m, p, _) in MODES.items()}, "w09_edit_topk": w09, "j05_reverse": j05, "j06_gloss_set": j06, "j07_synonyms": j07, "j08_expand_glosses": j08, "a11_headword_record": a11, "j06_fixture_glosses": j06_fixture, "j01_lookup": j01, "j04_sidecar_lookup": j04, "j09_phrases": j09, "f17_base_frequency": f17, "f18_domain_match": f18, "f19_features": f19, "f20_cosine": f20, "e06_guess_domain": e06, "q02_context_features": q02, "q03_resolve": q03, "q04_enrich": q04, "b03_hints": b03, "q08_tool_answer": q08, "a19_raw_json": a19, "b05_compact": b05, "b15_record_json": b15}
ORACLE_SQL = {"a08_freq_rank": A08, **{n: search_sql(c) for n, (_, _, c) in MODES.items()}, "w09_edit_topk": W09, "j05_reverse": f"WITH {SYN} SELECT * FROM rev", "j06_gloss_set": f"WITH {LINKS} SELECT word, rank, pos, gloss FROM links", "j07_synonyms": f"WITH {SYN} SELECT * FROM syn", "j08_expand_glosses": J08, "a11_headword_record": A11, "j06_fixture_glosses": J06F, "j01_lookup": J01, "j04_sidecar_lookup": J04, "j09_phrases": J09, "f17_base_frequency": F17, "f18_domain_match": F18, "f19_features": F19, "f20_cosine": F20, "e06_guess_domain": _e06(), "a19_raw_json": A19, "b05_compact": B05, "b15_record_json": _b15()}
