"""Queries on evaluation: sampling, prompts, judging, audits, reports and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import japanese as J
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import lexicon as L
from . import fixtures as V
from .lexical import records
from .texts import read

# Sampling


def w02(spark, sf):
    ranked = read(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("freq_rank"))
    return E.quantiles(ranked.withColumn("freq_rank", F.floor(F.col("freq_rank") / 5000).cast("long")), 20)


Q02 = """r AS (SELECT o_orderkey, floor(floor(o_totalprice) / 5000)::bigint AS freq_rank FROM orders),
 o AS (SELECT freq_rank, row_number() OVER (ORDER BY freq_rank) - 1 AS place, count(*) OVER () AS n FROM r),
 e AS (SELECT i, freq_rank AS edge FROM o JOIN range(1, 20) t(i) ON place = (i * n) // 20)"""
W02 = f"WITH {Q02} SELECT o_orderkey, freq_rank, least((SELECT count(*) FROM e WHERE edge <= freq_rank), 19)::int AS quantile FROM r"


def w03(spark, sf):
    names = read(spark, sf, "customer").select(F.col("c_custkey").alias("freq_rank"), F.lit(0).alias("entry_idx"), F.concat(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")), F.col("c_nationkey").cast("string")).alias("word"))
    return E.casefold_first(names)


W03 = "SELECT c_custkey AS freq_rank, 0 AS entry_idx, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END || c_nationkey::text AS word FROM customer QUALIFY row_number() OVER (PARTITION BY lower(c_mktsegment || c_nationkey::text) ORDER BY c_custkey) = 1"


def w04(spark, sf):
    return E.sample(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], 100, "o_orderkey", 42)


W04 = "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('42|' || o_orderkey::text), o_orderkey) <= 100"


def q09(spark, sf):
    """A sample set of the corpus's words, their length standing for the number of senses and their first letter for the domain."""
    from .lexical import a08

    keys = a08(spark, sf)
    words = keys.select(F.col("key").alias("word"), "freq_rank", F.lit(0).alias("entry_idx"), F.array(F.reverse("key")).alias("translations"), F.round(-F.log10(F.col("freq_rank") + 1.0), 6).alias("log_freq"), F.char_length("key").alias("n_senses"), F.substring("key", 1, 1).alias("domain"))
    return E.sample_set(words, "s", 42, 20, 20, 12, 50, 3)


# Prompts


def examples(spark):
    return spark.createDataFrame([(i, w, [{"e": s}]) for i, w, s in V.SENTENCES], "id long, word string, examples array<struct<e:string>>")


SENT = V.values("sent", "id, word, sentence", V.SENTENCES)
TAILS = "|".join(E.TAILS)
_PAT = f"'(?i)\\b(?:' || replace(word, '.', '\\.') || ')(?:{TAILS})?\\b'"


def f28(spark, sf):
    s, w = F.element_at(F.col("examples"), 1)["e"], F.col("word")
    return examples(spark).select("id", E.select_context(w, F.col("examples")).alias("context"), E.mark_target(s, w).alias("marked"))


F28 = f"WITH {SENT} SELECT id, CASE WHEN regexp_matches(sentence, {_PAT}) THEN sentence END AS context, regexp_replace(sentence, '(' || {_PAT} || ')', '【\\1】') AS marked FROM sent"
TEMPLATES = {"P1": "What does {word} mean in: {sentence}", "W1": "Translate {word}."}


def f29(spark, sf):
    return E.build_probes(examples(spark), TEMPLATES).select("id", "task", "sentence", "prompt", "prompt_ver")


F29 = f"""WITH {SENT}, m AS (SELECT id, word, CASE WHEN regexp_matches(sentence, {_PAT}) THEN regexp_replace(sentence, '(' || {_PAT} || ')', '【\\1】') END AS sentence FROM sent)
SELECT id, CASE WHEN sentence IS NULL THEN 'W1' ELSE 'P1' END AS task, sentence, CASE WHEN sentence IS NULL THEN 'Translate ' || word || '.' ELSE 'What does ' || word || ' mean in: ' || sentence END AS prompt, CASE WHEN sentence IS NULL THEN 'w1' ELSE 'p1' END || '_v1.txt@pr1' AS prompt_ver FROM m"""


def j15(spark, sf):
    """Orders as planned probes, of which those shipped in lineitem are stored."""
    plan = read(spark, sf, "orders").select(F.lit("s").alias("set_id"), F.col("o_orderkey").cast("string").alias("headword"), F.lit("m").alias("model_id"), F.col("o_orderstatus").alias("task"), F.lit("v").alias("prompt_ver"))
    stored = read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("headword")).distinct()
    stored = plan.join(stored, "headword").select(*E.PROBE_KEY, F.lit("x").alias("raw_output"), F.lit(None).cast("string").alias("parsed_json"))
    return E.pending(plan, stored)


J15 = "SELECT DISTINCT 's' AS set_id, o_orderkey::text AS headword, 'm' AS model_id, o_orderstatus AS task, 'v' AS prompt_ver FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"

# Judging


def f10(spark, sf):
    """On fixture answers and glosses, none of which holds compatibility characters."""
    rows = sorted({x for _, a, gs in V.ANSWERS for x in [a, *gs] if x} | {t for _, t in V.TEXTS[:3]})
    n = J.normalized(F.col("text"))
    return spark.createDataFrame([(r,) for r in rows], "text string").select("text", n.alias("norm"), J.strict(n).alias("strict"), F.concat_ws("|", F.array_sort(J.spellings(n))).alias("spellings"))


def norm_ja(x: str) -> str:
    sub = lambda a, p, by="": f"regexp_replace({a}, '{p.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    value = sub(sub(f"coalesce({x}, '')", f"{T.SPACE}+", " "), "^ | $")
    value = f"translate({sub(sub(value, J.MIDDLE_DOTS), J.LONG_VOWELS)}, '{J.KATAKANA}', '{J.HIRAGANA}')"
    return sub(f"lower({sub(value, J.PUNCTUATION)})", f"^{T.SPACE}+|{T.SPACE}+$")


_ROWS = sorted({x for _, a, gs in V.ANSWERS for x in [a, *gs] if x} | {t for _, t in V.TEXTS[:3]})
F10 = f"""WITH {V.values('t', 'text', [(r,) for r in _ROWS])}, n AS (SELECT text, {norm_ja('text')} AS norm FROM t), s AS (SELECT *, regexp_replace(norm, '(?:{J.PARTICLES})+$', '') AS strict FROM n)
SELECT *, array_to_string(list_sort(list_distinct(list_filter([norm, strict, translate(norm, '{J.HIRAGANA}', '{J.KATAKANA}'), translate(norm, '{J.KATAKANA}', '{J.HIRAGANA}')], lambda x: x <> ''))), '|') AS spellings FROM s"""
STEMS = ["暴走した", "普及させた", "断片的な", "慢性的な", "した", "", "引き締めの", "政策者用", "川"]


def f14(spark, sf):
    return spark.createDataFrame([(x,) for x in STEMS], "norm string").select("norm", F.explode(J.variants(F.col("norm"))).alias("variant"))


F14 = f"""WITH RECURSIVE {V.values('t', 'norm', [(x,) for x in STEMS])}, {V.values('sf', 's', [(x,) for x in J.SUFFIXES])},
 r AS (SELECT norm, norm AS variant, 0 AS depth FROM t UNION SELECT norm, left(variant, length(variant) - length(s)), depth + 1 FROM r JOIN sf ON ends_with(variant, s) AND length(variant) > length(s) WHERE depth < 3)
SELECT DISTINCT norm, variant FROM r WHERE variant <> ''"""


def f34(spark, sf):
    rows = spark.createDataFrame(V.ANSWERS, "id long, answer string, glosses array<string>").select("id", "answer", F.explode("glosses").alias("gloss"))
    each = rows.withColumn("g", F.struct(J.normalized(F.col("gloss"), False).alias("norm"), "gloss")).groupBy("id", "answer").agg(F.collect_list("g").alias("glosses"))
    return each.select("id", E.classify(J.normalized(F.col("answer"), False), F.col("glosses")).alias("v")).select("id", "v.*")


F34 = f"""WITH {V.values('a', 'id, answer, gloss', [(i, a, g) for i, a, gs in V.ANSWERS for g in gs])}, n AS (SELECT id, {norm_ja('answer')} AS a, {norm_ja('gloss')} AS g, gloss FROM a),
 m AS (SELECT id, a, min(gloss) FILTER (a = g) AS exact, min(gloss) FILTER ((contains(a, g) OR contains(g, a)) AND least(length(a), length(g)) / greatest(length(a), length(g)) >= 0.5) AS part FROM n GROUP BY id, a),
 v AS (SELECT *, CASE WHEN a = '' THEN 'empty_output' WHEN length(a) > 24 THEN 'too_long' WHEN exact IS NOT NULL THEN 'exact' WHEN part IS NOT NULL THEN 'substring' WHEN NOT regexp_matches(a, '{T.JAPANESE}') THEN 'unmatched_non_japanese' ELSE 'unmatched_japanese' END AS rule FROM m)
SELECT id, CASE rule WHEN 'exact' THEN 'K' WHEN 'substring' THEN 'P' WHEN 'unmatched_japanese' THEN 'X' ELSE 'U' END AS label, rule, CASE rule WHEN 'exact' THEN exact WHEN 'substring' THEN part END AS matched FROM v"""


def fixture_links(spark):
    return L.links(records(spark)).withColumn("norm", J.normalized(F.col("gloss")))


def q11(spark, sf):
    links = fixture_links(spark)
    expanded = L.expand_glosses(links.drop("norm")).withColumn("norm", J.normalized(F.col("gloss")))
    return E.judge(V.probes(spark), links, None, expanded, L.synonyms(links.drop("norm")))


def f31(spark, sf):
    return spark.createDataFrame([(i, v) for i, v in enumerate(V.VERDICTS)], "id long, answer string").select("id", E.verdict(F.col("answer")).alias("verdict"))


F31 = f"""WITH {V.values('a', 'id, answer', list(enumerate(V.VERDICTS)))}, l AS (SELECT id, lower(trim(coalesce(answer, ''))) AS a FROM a)
SELECT id, CASE WHEN starts_with(a, 'はい') OR starts_with(a, 'yes') OR starts_with(a, 'accept') THEN 'accept' WHEN starts_with(a, 'いいえ') OR starts_with(a, 'no') OR starts_with(a, 'reject') THEN 'reject' WHEN contains(a, 'はい') THEN 'accept' WHEN contains(a, 'いいえ') THEN 'reject' ELSE 'unknown' END AS verdict FROM l"""

# Reports

PRO = V.values("p", "id, set_id, headword, task, raw_output", [(i, s, h, t, o) for i, s, h, t, o, _, _ in V.PROBES])
JUD = V.values("j", "probe_id, label, rule, matched, judge_ver", V.JUDGMENTS)
SAM = V.values("s", "headword, layer, quantile, log_freq", V.SAMPLES)
LOADED = f"{PRO}, {JUD}, {SAM}, l AS (SELECT p.id, p.headword, p.task, j.label, s.layer, s.quantile, s.log_freq FROM p JOIN j ON j.probe_id = p.id AND judge_ver = 'j2' LEFT JOIN s ON s.headword = p.headword)"


def loaded(spark):
    return E.load_judgments(V.probes(spark), V.judgments(spark), V.samples(spark))


def j14(spark, sf):
    return loaded(spark).select("id", "headword", "task", "label", "layer", "quantile", "log_freq")


def w05(spark, sf):
    return E.audit_queue(V.probes(spark), V.judgments(spark), V.samples(spark), 2)


W05 = f"""WITH {PRO}, {JUD}, {SAM} SELECT coalesce(quantile, 0) AS bucket, p.id AS probe_id FROM p JOIN s USING (headword) LEFT JOIN j ON j.probe_id = p.id AND judge_ver = 'j2'
WHERE raw_output IS NOT NULL AND (label IS NULL OR label <> 'K') QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY p.id) <= 2"""


def e07(spark, sf):
    return E.curve(loaded(spark))


_COUNTS = "count(*) AS n, count(*) FILTER (label = 'K') AS K, count(*) FILTER (label = 'P') AS P, count(*) FILTER (label = 'X') AS X, count(*) FILTER (label = 'U') AS U"
_RATES = "round(K / n, 4) AS strict, round((K + P) / n, 4) AS lenient"
E07 = f"WITH {LOADED}, c AS (SELECT quantile, {_COUNTS}, round(min(log_freq)::double, 2) AS log_freq_min, round(max(log_freq)::double, 2) AS log_freq_max FROM l WHERE quantile IS NOT NULL GROUP BY quantile) SELECT *, {_RATES}, round(X / n, 4) AS x_rate, round(U / n, 4) AS u_rate FROM c"


def e08(spark, sf):
    return E.overall(loaded(spark))


E08 = f"WITH {LOADED}, c AS (SELECT {_COUNTS} FROM l) SELECT *, {_RATES} FROM c"


def e09(spark, sf):
    return E.audit_summary(V.tasks(spark), V.judgments(spark))


E09 = f"""WITH {V.values('t', 'id, probe_id, status, result', V.TASKS)}, {JUD}, r AS (SELECT label IN ('K', 'P') AS kp, result->>'$.verdict' = 'accept' AS yes FROM t JOIN j USING (probe_id) WHERE status = 'done' AND result IS NOT NULL AND judge_ver = 'j2')
SELECT count(*) AS audited, count(*) FILTER (kp) AS audited_kp, count(*) FILTER (NOT kp) AS audited_xu, round(count(*) FILTER (kp AND yes) / count(*) FILTER (kp), 4) AS agreement, round(count(*) FILTER (NOT kp AND yes) / count(*) FILTER (NOT kp), 4) AS recovery FROM r"""


def e09_labels(spark, sf):
    """Labels as audits: quality is the auditor's verdict, toxic tells two classes apart."""
    labels = read(spark, sf, "labels")
    tasks = labels.select(F.col("doc_id").alias("probe_id"), F.lit("done").alias("status"), F.to_json(F.struct(F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("verdict"))).alias("result"))
    judged = labels.select(F.col("doc_id").alias("probe_id"), F.when(F.col("toxic") == 0, "K").otherwise("X").alias("label"), F.lit("j2").alias("judge_ver"))
    return E.audit_summary(tasks, judged)


E09L = "SELECT count(*) AS audited, count(*) FILTER (toxic = 0) AS audited_kp, count(*) FILTER (toxic <> 0) AS audited_xu, round(count(*) FILTER (toxic = 0 AND quality = 1) / count(*) FILTER (toxic = 0), 4) AS agreement, round(count(*) FILTER (toxic <> 0 AND quality = 1) / count(*) FILTER (toxic <> 0), 4) AS recovery FROM labels"


def e10(spark, sf):
    return E.adjusted(E.curve(loaded(spark)), F.lit(53 / 58), F.lit(88 / 106)).select("quantile", "adjusted")


E10 = f"WITH c AS ({E07}) SELECT quantile, round((K + P * (53 / 58) + X * (88 / 106)) / n, 4) AS adjusted FROM c"


def e11(spark, sf):
    return E.dictionary_stats(records(spark))


def e11_tags(spark, sf):
    return E.top_values(read(spark, sf, "part"), "p_type", 12)


E11T = "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 12"


def e12(spark, sf):
    return E.field_profile(read(spark, sf, "events"), "props")


E12 = "SELECT field, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 4) AS share FROM (SELECT unnest(json_keys(props)) AS field FROM events) GROUP BY field"


def e13(spark, sf):
    return E.run_summary(read(spark, sf, "events").select("event_type", F.col("value").alias("latency")), ["event_type"])


E13 = "SELECT event_type, n, round(v[least(n - 1, floor(n * 0.5))::int + 1], 3) AS p50, round(v[least(n - 1, floor(n * 0.95))::int + 1], 3) AS p95 FROM (SELECT event_type, count(value) AS n, list_sort(list(value) FILTER (value IS NOT NULL)) AS v FROM events GROUP BY 1)"


def e14(spark, sf):
    return E.counters(V.judgments(spark).where("judge_ver = 'j2'"))


E14 = f"WITH {JUD} SELECT 'label' AS what, label AS name, count(*) AS n FROM j WHERE judge_ver = 'j2' GROUP BY ALL UNION ALL SELECT 'rule', rule, count(*) FROM j WHERE judge_ver = 'j2' GROUP BY ALL"


def e15(spark, sf):
    """Rules on labelled documents: accept is quality, the baseline a short text, a second rule one of English, a third either."""
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    short, english = F.col("n_chars") < 1500, F.col("lang") == "en"
    return E.rule_evaluation(docs.select((F.col("quality") == 1).alias("accept"), short.alias("baseline"), english.alias("english"), (short | english).alias("either")).withColumn("short", F.col("baseline")), ("short", "english", "either"))


E15 = """WITH d AS (SELECT quality = 1 AS accept, n_chars < 1500 AS baseline, lang = 'en' AS english FROM documents JOIN labels USING (doc_id)),
 r AS (SELECT 'short' AS rule, accept, baseline, baseline AS hit FROM d UNION ALL SELECT 'english', accept, baseline, english FROM d UNION ALL SELECT 'either', accept, baseline, baseline OR english FROM d)
SELECT rule, count(*) FILTER (hit) AS accepted, count(*) FILTER (hit AND accept) AS good, count(*) FILTER (hit AND NOT baseline) AS conversions, count(*) FILTER (hit AND NOT accept) AS false_positives,
 round(count(*) FILTER (hit AND accept) / count(*) FILTER (accept), 3) AS recall, round(count(*) FILTER (hit AND accept) / greatest(count(*) FILTER (hit), 1), 3) AS precision FROM r GROUP BY rule"""


def e16(spark, sf):
    return E.tally(read(spark, sf, "events"), "event_type")


E16 = "SELECT event_type AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::double AS percent FROM events GROUP BY 1"


def b10(spark, sf):
    return E.latest(read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


B10 = "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def f35(spark, sf):
    """Each fixture gloss as an answer to its own first sense among the others of its word."""
    r = records(spark).where(F.size("senses") >= 2)
    first, rest = F.element_at("senses", 1)["translations"], F.flatten(F.transform(F.slice("senses", 2, 100), lambda s: s["translations"]))
    return r.select("key", F.explode(F.concat("own", F.array(F.lit(""), F.lit("別")))).alias("answer"), first.alias("intended"), rest.alias("others")).select("key", "answer", E.sense_verdict(F.col("answer"), J.variants(F.col("answer")), F.col("intended"), F.col("others")).alias("verdict"))




TSK = V.values("t", "id, probe_id, status, result", V.TASKS)


def probes_with_context(spark):
    return V.probes(spark).withColumn("parsed_json", F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"sentence": "of '), "headword", F.lit('"}'))).when(F.col("id") % 3 == 1, "{bad"))


def j11(spark, sf):
    return E.pending_audits(V.tasks(spark), probes_with_context(spark))


J11 = f"WITH {TSK}, {PRO} SELECT t.id AS task_id, probe_id, headword, raw_output, CASE WHEN p.id % 3 = 0 THEN 'of ' || headword END AS context FROM t JOIN p ON p.id = probe_id WHERE status = 'pending'"


def a17(spark, sf):
    return E.audited(V.tasks(spark), V.probes(spark), V.judgments(spark))


A17 = f"""WITH {TSK}, {PRO}, {JUD} SELECT headword, raw_output AS output, label, result->>'$.verdict' = 'accept' AS accept FROM t JOIN p ON p.id = t.probe_id JOIN j ON j.probe_id = t.probe_id
WHERE status = 'done' AND result IS NOT NULL AND p.task = 'P1' AND result->>'$.verdict' IN ('accept', 'reject')"""


def j18(spark, sf):
    return E.sampled_records(V.samples(spark), records(spark)).select("headword", "layer", "quantile", "key", "freq_rank")


_KEYS = V.values("k", "key, freq_rank", [(k, i) for i, (k, _) in enumerate(V.LEXICON)])
J18 = f"WITH {SAM}, {_KEYS} SELECT headword, layer, quantile, key, freq_rank FROM s JOIN k ON key = lower(headword)"


def e17(spark, sf):
    """Customers as samples, their segments being layers, out of all those of a nation as quantiles."""
    c = read(spark, sf, "customer")
    return E.sample_summary(c.where("c_acctbal > 0").select(F.col("c_mktsegment").alias("layer")), 10, c.select(F.col("c_nationkey").alias("quantile")))


E17 = """WITH q AS (SELECT c_nationkey::text AS name, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT * FROM customer WHERE c_acctbal > 0)
SELECT 'layer' AS what, c_mktsegment AS name, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'total', NULL, count(*) FROM s
UNION ALL SELECT 'quantile_size', name, n FROM q UNION ALL SELECT 'quantile_fill', name, least(n, 10) FROM q"""


def e18(spark, sf):
    return E.fallback_share(loaded(spark))


E18 = f"WITH {LOADED} SELECT quantile, count(*) AS n, round(avg((task = 'W1')::int), 4) AS w1_share FROM l WHERE quantile IS NOT NULL GROUP BY quantile"


QUERIES = {"j11_pending_audits": j11, "a17_audited": a17, "j18_sampled_records": j18, "e17_sample_summary": e17, "e18_fallback_share": e18, "w02_quantiles": w02, "w03_casefold_dedupe": w03, "w04_stratified_sample": w04, "q09_sample_set": q09, "f28_mark_target": f28, "f29_build_probe": f29, "j15_probe_cache": j15, "f10_ja_normalize": f10, "f14_variants": f14, "f34_classify": f34, "f31_verdict": f31, "q11_judge": q11, "j14_load_judgments": j14, "w05_audit_queue": w05, "e07_curve": e07, "e08_overall": e08, "e09_audit_summary": e09, "e09_labels": e09_labels, "e10_adjusted_curve": e10, "e11_dict_stats": e11, "e11_top_values": e11_tags, "e12_field_profile": e12, "e13_run_summary": e13, "e14_counters": e14, "e15_rule_eval": e15, "e16_tally": e16, "b10_meta_upsert": b10, "f35_sense_verdict": f35}
ORACLE_SQL = {"j11_pending_audits": J11, "a17_audited": A17, "j18_sampled_records": J18, "e17_sample_summary": E17, "e18_fallback_share": E18, "w02_quantiles": W02, "w03_casefold_dedupe": W03, "w04_stratified_sample": W04, "f28_mark_target": F28, "f29_build_probe": F29, "j15_probe_cache": J15, "f10_ja_normalize": F10, "f14_variants": F14, "f34_classify": F34, "f31_verdict": F31, "j14_load_judgments": f"WITH {LOADED} SELECT * FROM l", "w05_audit_queue": W05, "e07_curve": E07, "e08_overall": E08, "e09_audit_summary": E09, "e09_labels": E09L, "e10_adjusted_curve": E10, "e11_top_values": E11T, "e12_field_profile": E12, "e13_run_summary": E13, "e14_counters": E14, "e15_rule_eval": E15, "e16_tally": E16, "b10_meta_upsert": B10}
