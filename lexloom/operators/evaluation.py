"""Evaluation of answers: sampling by frequency, prompts, probes, judging, audits and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import japanese as J
from ..functions import text as T

# Versions, limits and tails that results carry or depend on.
JUDGE, PROMPTER, AUDIT = "j2", "pr1", "a1"
LONGEST_ANSWER, LEAST_OVERLAP = 24, 0.5
TAILS = ("s", "es", "ed", "d", "ing", "er", "est", "ly")
PROBE_KEY = ("set_id", "headword", "model_id", "task", "prompt_ver")


# Sampling


def quantiles(ranked: DataFrame, n: int, rank: str = "freq_rank") -> DataFrame:
    """W-02: adds quantile: how many edges a rank reaches, n - 1 at most, edge i being the rank at place i * rows // n.

    Not ntile: equal ranks stay together. The rows are numbered once over distinct ranks, so a rank that many rows share is one row
    there; the n - 1 edges are all that is broadcast.
    """
    counts = ranked.groupBy(F.col(rank).alias("r")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("to", F.sum("c").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    total = counts.agg(F.sum("c").alias("total"))
    places = total.select("total", F.explode(F.sequence(F.lit(1), F.lit(max(1, n - 1)))).alias("i")).withColumn("place", F.floor(F.col("i") * F.col("total") / n))
    met = places.join(upto, (F.col("place") < F.col("to")) & (F.col("place") >= F.col("to") - F.col("c")))
    edges = met.where(F.col("i") < n).agg(F.sort_array(F.collect_list("r")).alias("__edges"))  # n - 1 values
    reached = F.size(F.filter("__edges", lambda e: e <= F.col(rank)))
    return ranked.crossJoin(F.broadcast(edges)).withColumn("quantile", F.least(reached, F.lit(n - 1))).drop("__edges")


def casefold_first(records: DataFrame, word: str = "word", order: tuple[str, ...] = ("freq_rank", "entry_idx")) -> DataFrame:
    """W-03: of words equal in lower case the first."""
    return records.withColumn("__n", F.row_number().over(Window.partitionBy(F.lower(word)).orderBy(*order))).where("__n = 1").drop("__n")


def sample(rows: DataFrame, strata: list[str], n: int, key: str, seed: int) -> DataFrame:
    """W-04: n rows of each stratum, all if it has fewer, without replacement: those of the smallest hashes of seed and key.

    A task keeps n rows of a stratum at most before the shuffle, so a stratum of any size is safe.
    """
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*strata).orderBy(draw, key))).where(F.col("__n") <= n).drop("__n")


def sample_set(records: DataFrame, set_id: str, seed: int, n_quantiles: int = 20, per_quantile: int = 100, multi_sense_min: int = 3, multi_sense_n: int = 200, domain_n: int = 200) -> DataFrame:
    """Q-09: set_id, headword, layer, quantile, log_freq, n_senses, domain, is_duplicate.

    records: word, freq_rank, entry_idx, translations, log_freq, n_senses, domain. ASCII words with a translation, folded in case. The main
    layer is drawn by quantile of rank; words of many senses and words by domain are layers beside it, flagged where the main layer has them.
    """
    fit = casefold_first(records.where(F.col("word").rlike("^[A-Za-z-]+$") & (F.size("translations") > 0)))
    placed = quantiles(fit, n_quantiles)
    row = lambda d, layer, q, dom: d.select(F.lit(set_id).alias("set_id"), F.col("word").alias("headword"), F.lit(layer).alias("layer"), q.cast("int").alias("quantile"), "log_freq", "n_senses", dom.alias("domain"))
    none = F.lit(None)
    main = row(sample(placed, ["quantile"], per_quantile, "word", seed), "main", F.col("quantile"), none.cast("string"))
    many = row(sample(fit.where(F.col("n_senses") >= multi_sense_min).withColumn("__all", F.lit(1)), ["__all"], multi_sense_n, "word", seed + 1), "multi_sense", none, none.cast("string"))
    by_domain = row(sample(fit, ["domain"], domain_n, "word", seed + 2), "domain", none, F.col("domain"))
    every = main.unionByName(many).unionByName(by_domain)
    in_main = main.select(F.col("headword").alias("__h"))
    return every.join(in_main, F.col("headword") == F.col("__h"), "left").withColumn("is_duplicate", (F.col("__h").isNotNull() & (F.col("layer") != "main")).cast("long")).drop("__h")


def sample_summary(samples: DataFrame, per_quantile: int, scanned: DataFrame | None = None) -> DataFrame:
    """E-17: what, name, n: rows by layer and in total; with scanned (quantile) also how many rows each quantile has and how many of them fill it."""
    none = F.lit(None).cast("string")
    out = samples.groupBy(F.col("layer").alias("name")).agg(F.count("*").alias("n")).select(F.lit("layer").alias("what"), "name", "n")
    out = out.unionByName(samples.agg(F.count("*").alias("n")).select(F.lit("total").alias("what"), none.alias("name"), "n"))
    if scanned is None:
        return out
    sizes = scanned.where("quantile is not null").groupBy(F.col("quantile").cast("string").alias("name")).agg(F.count("*").alias("n"))
    return out.unionByName(sizes.select(F.lit("quantile_size").alias("what"), "name", "n")).unionByName(sizes.select(F.lit("quantile_fill").alias("what"), "name", F.least("n", F.lit(per_quantile).cast("long")).alias("n")))


def replace_set(stored: DataFrame, new: DataFrame) -> DataFrame:
    """B-07, B-11: stored samples without the sets that new ones bring, and the new ones."""
    return stored.join(new.select("set_id").distinct(), "set_id", "left_anti").unionByName(new)


def sampled_records(samples: DataFrame, records: DataFrame) -> DataFrame:
    """J-18: samples with the first entry of their headword; headwords that are no key have no row."""
    first = records.where("entry_idx = 0").drop("entry_idx", *[c for c in samples.columns if c in records.columns])
    return samples.join(first, T.normalized(F.col("headword")) == F.col("key"))


# Senses that an example tells apart


def sense_example(c: Column) -> Column:
    """F-08: what follows e.g.: in a sense's text, up to [-] or the end; empty if there is none."""
    return T.strip(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?s)e\.g\.:{T.SPACE}*(.*?)(?=\[-\]|\z)", 1))


def usable_senses(word: Column, senses: Column) -> Column:
    """F-08: array of struct(index, example, translations): the senses with translations and an example that holds the word
    as a whole. Translations are normalised but for compatibility characters, which no built-in function folds within an array."""
    whole = F.concat(F.lit(r"(?iU)\b"), quoted(word), F.lit(r"\b"))
    each = F.transform(senses, lambda s, i: F.struct(i.alias("index"), sense_example(s["text"]).alias("example"), F.array_sort(F.array_distinct(F.transform(s["translations"], lambda t: J.normalized(t, False)))).alias("translations")))
    return F.filter(each, lambda s: (s["example"] != "") & F.call_function("rlike", s["example"], whole) & (F.size(s["translations"]) > 0))


def polysemous(records: DataFrame, min_senses: int = 3, min_length: int = 4, min_rank: int = 3000) -> DataFrame:
    """C-24: word, freq_rank, usable: content words past the head of the list, with senses enough, whose first two usable senses differ in translations."""
    fit = records.where(F.col("word").rlike("^[A-Za-z-]+$") & (F.size("translations") > 0) & (F.col("n_senses") >= min_senses) & (F.char_length("word") >= min_length) & (F.col("freq_rank") >= min_rank))
    each = fit.where(~T.is_stop_word(F.lower("word"))).select("word", "freq_rank", usable_senses(F.col("word"), F.col("senses")).alias("usable"))
    return each.where((F.size("usable") >= 2) & (F.col("usable")[0]["translations"] != F.col("usable")[1]["translations"]))


# Prompts and probes


def quoted(word: Column) -> Column:
    """The word as a pattern that matches just it."""
    return F.regexp_replace(word, r"([^0-9A-Za-z\s\x{80}-\x{10FFFF}_])", r"\\$1")


def target_pattern(word: Column) -> Column:
    """The headword, with or without a tail, between word edges, in any case."""
    return F.concat(F.lit(r"(?i)\b(?:"), quoted(word), F.lit(")(?:" + "|".join(TAILS) + r")?\b"))


def select_context(word: Column, examples: Column, any_sentence: bool = False) -> Column:
    """F-28: the first example (array of struct with e) that has the word; null if none has, or the first one if any will do."""
    sentences = F.filter(F.transform(examples, lambda x: x["e"]), lambda s: s.isNotNull() & (s != ""))
    first = F.try_element_at(F.filter(sentences, lambda s: F.call_function("rlike", s, target_pattern(word))), F.lit(1))
    return F.coalesce(first, F.try_element_at(sentences, F.lit(1))) if any_sentence else first


def mark_target(sentence: Column, word: Column) -> Column:
    """F-28: the sentence with the first occurrence of the word in 【】."""
    return F.regexp_replace(sentence, F.concat(F.lit("(?s)^(.*?)("), target_pattern(word), F.lit(")")), F.lit("$1【$2】"))


def build_probes(records: DataFrame, templates: dict[str, str], task: str | None = None) -> DataFrame:
    """F-29: adds task, sentence, prompt, prompt_ver. Without a usable sentence P1 becomes W1. templates: by task, with {word} and {sentence}."""
    if task not in (None, "P1", "W1"):
        raise ValueError(f"unknown task: {task}")
    sentence = mark_target(select_context(F.col("word"), F.col("examples")), F.col("word"))
    out = records.withColumn("sentence", sentence).withColumn("task", F.lit("W1") if task == "W1" else F.when(F.col("sentence").isNotNull(), "P1").otherwise("W1"))
    prompt = F.when(F.col("task") == "P1", F.lit(templates["P1"])).otherwise(F.lit(templates["W1"]))
    prompt = F.replace(F.replace(prompt, F.lit("{word}"), F.col("word")), F.lit("{sentence}"), F.coalesce("sentence", F.lit("")))
    return out.withColumn("prompt", prompt).withColumn("prompt_ver", F.concat(F.lower("task"), F.lit(f"_v1.txt@{PROMPTER}")))


def pending(plan: DataFrame, probes: DataFrame, rerun_errors: bool = False) -> DataFrame:
    """J-15, Q-10: the planned probes that have no stored one; with rerun_errors also those whose stored one failed. A key comes once."""
    failed = F.col("raw_output").isNull() & F.get_json_object("parsed_json", "$.error").isNotNull()
    done = probes.where(~failed) if rerun_errors else probes
    return plan.dropDuplicates(list(PROBE_KEY)).join(done, list(PROBE_KEY), "left_anti")


def ask(plan: DataFrame, client: Callable[[], Callable[[str], dict]], retries: int = 3, backoff: float = 1.0) -> DataFrame:
    """A-16: adds raw_output, tokens_in, tokens_out, latency_ms, parsed_json of each prompt, asked through a client that each task makes for itself.

    A call that fails is tried again after backoff * 2 ** (n - 1) seconds; after the last the row has no output and the error in parsed_json.
    """
    schema = plan.schema.simpleString()[len("struct<") : -1] + ",raw_output:string,tokens_in:bigint,tokens_out:bigint,latency_ms:bigint,parsed_json:string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        call = client()
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                error = ""
                for n in range(1, retries + 2):
                    try:
                        began = time.monotonic()
                        got = call(prompt)
                        rows.append((got.get("text"), got.get("tokens_in"), got.get("tokens_out"), int((time.monotonic() - began) * 1000), None))
                        break
                    except Exception as e:  # noqa: BLE001  whatever the client raises is this probe's result
                        error = f"{type(e).__name__}: {e}"
                        if n <= retries:
                            time.sleep(backoff * 2 ** (n - 1))
                else:
                    rows.append((None, None, None, None, json.dumps({"error": error})))
            yield batch.assign(**dict(zip(("raw_output", "tokens_in", "tokens_out", "latency_ms", "parsed_json"), map(list, zip(*rows, strict=True)) if rows else ([],) * 5, strict=True)))

    return plan.mapInPandas(run, schema)


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = PROBE_KEY) -> DataFrame:
    """B-06, D15: stored rows but those whose key comes again, and the new ones."""
    return stored.join(new, list(keys), "left_anti").unionByName(new.dropDuplicates(list(keys)))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """B-09, B-10: of each key the last row of a log. An aggregate, so a key with many rows is combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


# Judging


def classify(answer: Column, glosses: Column, resolved: Column | None = None) -> Column:
    """F-34: struct(label, rule, matched) of a normalised answer against an array of struct(norm, gloss).

    In this order: empty, too long, exact, substring of at least half the longer one's length, no Japanese, resolved (the name of the rule
    by which a resolver accepts the answer, else null), else unmatched. Of several matches the least gloss.
    """
    verdict = lambda label, rule, matched: F.struct(F.lit(label).alias("label"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"), matched.alias("matched"))
    none, known = F.lit(None).cast("string"), F.filter(glosses, lambda g: g["norm"] != "")
    exact = F.array_min(F.transform(F.filter(known, lambda g: g["norm"] == answer), lambda g: g["gloss"]))
    shorter = lambda g: F.least(F.char_length(g["norm"]), F.char_length(answer))
    longer = lambda g: F.greatest(F.char_length(g["norm"]), F.char_length(answer))
    partial = F.array_min(F.transform(F.filter(known, lambda g: (g["norm"].contains(answer) | answer.contains(g["norm"])) & (shorter(g) / longer(g) >= LEAST_OVERLAP)), lambda g: g["gloss"]))
    chain = (
        F.when(F.coalesce(answer, F.lit("")) == "", verdict("U", "empty_output", none))
        .when(F.char_length(answer) > LONGEST_ANSWER, verdict("U", "too_long", none))
        .when(exact.isNotNull(), verdict("K", "exact", exact))
        .when(partial.isNotNull(), verdict("P", "substring", partial))
        .when(~T.has_japanese(answer), verdict("U", "unmatched_non_japanese", none))
    )
    if resolved is not None:
        chain = chain.when(resolved.isNotNull(), verdict("P", resolved, answer))
    return chain.otherwise(verdict("X", "unmatched_japanese", none))


def resolver_rules(answers: DataFrame, links: DataFrame, expanded: DataFrame, synonyms: DataFrame, capacity: int = 4) -> DataFrame:
    """J-19, Q-12: answers (id, word, norm) to (id, rule): synonym_gloss if a variant is a gloss of the word or of a synonym, else
    synonym_reverse if one of the first headwords of a variant is a synonym. Others have no row. Equi-joins on variants.
    """
    each = answers.select("id", "word", F.explode(J.variants(F.col("norm"))).alias("variant"))
    by_gloss = each.join(expanded.select(F.col("word").alias("__w"), F.col("norm").alias("__n")).distinct(), (F.col("word") == F.col("__w")) & (F.col("variant") == F.col("__n")), "left_semi").select("id").distinct()
    from .lexicon import reverse

    hits = reverse(each.select(F.col("variant").alias("gloss")), links, capacity).select("gloss", F.lower("word").alias("hit"))
    known = synonyms.select(F.col("word").alias("__w"), F.lower("synonym").alias("__s")).distinct()
    by_reverse = each.join(hits, F.col("variant") == F.col("gloss")).join(known, (F.col("word") == F.col("__w")) & (F.col("hit") == F.col("__s")), "left_semi").select("id").distinct()
    both = by_gloss.withColumn("rule", F.lit("synonym_gloss")).unionByName(by_reverse.withColumn("rule", F.lit("synonym_reverse")))
    return both.groupBy("id").agg(F.min("rule").alias("rule"))


def judge(probes: DataFrame, links: DataFrame, judgments: DataFrame | None = None, expanded: DataFrame | None = None, synonyms: DataFrame | None = None, compatible: bool = True) -> DataFrame:
    """Q-11, J-16: probes (id, headword, raw_output) to probe_id, label, rule, matched, judge_ver; those judged before are left out.

    links, and the resolver's expanded and synonyms, are tables of the lexicon with a column norm beside gloss.
    """
    new = probes if judgments is None else probes.join(judgments.where(F.col("judge_ver") == JUDGE).select(F.col("probe_id").alias("__p")), F.col("id") == F.col("__p"), "left_anti")
    asked = new.select("id", F.lower(F.trim("headword")).alias("word"), J.normalized(F.col("raw_output"), compatible).alias("norm"))
    glosses = links.groupBy(F.col("word").alias("__w")).agg(F.collect_list(F.struct("norm", "gloss")).alias("glosses"))
    joined = asked.join(glosses, F.col("word") == F.col("__w"), "left").withColumn("glosses", F.coalesce("glosses", F.expr("cast(array() as array<struct<norm:string,gloss:string>>)")))
    resolved = None
    if expanded is not None and synonyms is not None:
        rules = resolver_rules(asked, links.drop("gloss").withColumnRenamed("norm", "gloss"), expanded, synonyms)
        joined = joined.join(rules.withColumnRenamed("id", "__r"), F.col("id") == F.col("__r"), "left")
        resolved = F.col("rule")
    return joined.select(F.col("id").alias("probe_id"), classify(F.col("norm"), F.col("glosses"), resolved).alias("v")).select("probe_id", "v.label", "v.rule", "v.matched", F.lit(JUDGE).alias("judge_ver"))


def load_judgments(probes: DataFrame, judgments: DataFrame, samples: DataFrame, version: str = JUDGE, layer: str | None = None) -> DataFrame:
    """J-14: probes with their judgments and samples. A word in several layers gives a row for each; `layer` keeps one of them."""
    own = samples if layer is None else samples.where(F.col("layer") == layer)
    s = own.select(F.col("set_id").alias("__s"), F.col("headword").alias("__h"), "layer", "quantile", "log_freq", "domain")
    j = judgments.where(F.col("judge_ver") == version).select(F.col("probe_id").alias("__p"), "label", "rule", "matched")
    return probes.join(j, F.col("id") == F.col("__p")).join(s, (F.col("set_id") == F.col("__s")) & (F.col("headword") == F.col("__h")), "left").drop("__p", "__s", "__h")


# Audits


def audit_queue(probes: DataFrame, judgments: DataFrame, samples: DataFrame, per_layer: int, version: str = JUDGE) -> DataFrame:
    """J-13, W-05: bucket, probe_id: the first answers by id of each quantile that are not exact; no quantile counts as 0, no judgment as not exact."""
    j = judgments.where(F.col("judge_ver") == version).select(F.col("probe_id").alias("__p"), "label")
    rows = probes.where("raw_output is not null").join(samples.select("set_id", "headword", "quantile"), ["set_id", "headword"]).join(j, F.col("id") == F.col("__p"), "left").where("label is null or label <> 'K'")
    bucket = F.coalesce("quantile", F.lit(0))
    return rows.select(bucket.alias("bucket"), F.col("id").alias("probe_id")).withColumn("__n", F.row_number().over(Window.partitionBy("bucket").orderBy("probe_id"))).where(F.col("__n") <= per_layer).drop("__n")


def audit_prompt(template: str, word: Column, glosses: Column, output: Column, context: Column) -> Column:
    """F-30: the first 20 glosses in order; (none) and (empty) for what there is not."""
    listed = F.array_join(F.slice(F.array_sort(glosses), 1, 20), ", ")
    or_else = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)
    out: Column = F.lit(template)
    for name, value in (("word", word), ("glosses", or_else(listed, "(none)")), ("context", or_else(context, "(none)")), ("output", or_else(output, "(empty)"))):
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out


def verdict(c: Column) -> Column:
    """F-31: accept, reject or unknown, by how the answer starts, then by what it holds."""
    text = F.lower(T.strip(F.coalesce(c, F.lit(""))))
    starts = lambda *xs: F.exists(F.array(*map(F.lit, xs)), lambda x: text.startswith(x))
    return F.when(starts("はい", "yes", "accept"), "accept").when(starts("いいえ", "no", "reject"), "reject").when(text.contains("はい"), "accept").when(text.contains("いいえ"), "reject").otherwise("unknown")


def audit_key(probe_id: Column, word: Column, output: Column, model_id: Column) -> Column:
    """F-32."""
    return F.sha2(F.concat_ws("|", probe_id.cast("string"), word, F.coalesce(output, F.lit("")), model_id, F.lit(AUDIT)), 256)


def context_of(parsed: Column) -> Column:
    """F-33: the sentence in a probe's JSON; null if there is none or the JSON is bad."""
    return F.get_json_object(parsed, "$.sentence")


def pending_audits(tasks: DataFrame, probes: DataFrame) -> DataFrame:
    """J-11: task_id, probe_id, headword, raw_output, context of the audits that wait and whose probe is there."""
    p = probes.select(F.col("id").alias("__p"), "headword", "raw_output", context_of(F.col("parsed_json")).alias("context"))
    return tasks.where("status = 'pending'").join(p, F.col("probe_id") == F.col("__p")).select(F.col("id").alias("task_id"), "probe_id", "headword", "raw_output", "context")


def audited(tasks: DataFrame, probes: DataFrame, judgments: DataFrame, task: str = "P1") -> DataFrame:
    """A-17: headword, output, label, accept: audited answers to `task`, those accepted or rejected, a row for each judgment of a probe."""
    done = tasks.where("status = 'done' and result is not null").select("probe_id", F.get_json_object("result", "$.verdict").alias("__v")).where(F.col("__v").isin("accept", "reject"))
    p = probes.where(F.col("task") == task).select(F.col("id").alias("__p"), "headword", F.col("raw_output").alias("output"))
    j = judgments.select(F.col("probe_id").alias("__j"), "label")
    return done.join(p, F.col("probe_id") == F.col("__p")).join(j, F.col("probe_id") == F.col("__j")).select("headword", "output", "label", (F.col("__v") == "accept").alias("accept"))


def fallback_share(judged: DataFrame) -> DataFrame:
    """E-18: quantile, n, w1_share: how many probes of each quantile had no sentence."""
    return judged.where("quantile is not null").groupBy("quantile").agg(F.count("*").alias("n"), F.round(F.avg((F.col("task") == "W1").cast("double")), 4).alias("w1_share"))


def audit_summary(tasks: DataFrame, judgments: DataFrame, version: str | None = JUDGE) -> DataFrame:
    """E-09, J-12: one row: audited, audited_kp, audited_xu, agreement, recovery. version=None counts a probe for each of its judgments."""
    j = judgments if version is None else judgments.where(F.col("judge_ver") == version)
    rows = tasks.where("status = 'done' and result is not null").join(j.select(F.col("probe_id").alias("__p"), "label"), F.col("probe_id") == F.col("__p")).withColumn("verdict", F.get_json_object("result", "$.verdict"))
    kp, yes = F.col("label").isin("K", "P"), F.col("verdict") == "accept"
    rate = lambda part: F.round(F.try_divide(F.count_if(part & yes), F.count_if(part)), 4)
    return rows.agg(F.count("*").alias("audited"), F.count_if(kp).alias("audited_kp"), F.count_if(~kp).alias("audited_xu"), rate(kp).alias("agreement"), rate(~kp).alias("recovery"))


# Reports


def _rates(*more: Column) -> list[Column]:
    n, of = F.count("*"), lambda *labels: F.count_if(F.col("label").isin(*labels))
    share = lambda *labels: F.round(F.try_divide(of(*labels), n), 4)
    return [n.alias("n"), *[of(x).alias(x) for x in "KPXU"], *more, share("K").alias("strict"), share("K", "P").alias("lenient")]


def curve(judged: DataFrame) -> DataFrame:
    """E-07: by quantile the counts, frequency range and rates; rows without a quantile are left out."""
    n = F.count("*")
    low, high = F.round(F.min("log_freq"), 2).alias("log_freq_min"), F.round(F.max("log_freq"), 2).alias("log_freq_max")
    return judged.where("quantile is not null").groupBy("quantile").agg(*_rates(low, high), F.round(F.count_if(F.col("label") == "X") / n, 4).alias("x_rate"), F.round(F.count_if(F.col("label") == "U") / n, 4).alias("u_rate"))


def overall(judged: DataFrame) -> DataFrame:
    """E-08: one row; of nothing the rates are 0."""
    return judged.agg(*_rates()).fillna(0.0, ["strict", "lenient"])


def adjusted(rows: DataFrame, accept_p: Column, accept_x: Column) -> DataFrame:
    """E-10: a curve's rates with the shares of P and X that auditors accept."""
    return rows.withColumn("adjusted", F.round((F.col("K") + F.col("P") * accept_p + F.col("X") * accept_x) / F.col("n"), 4))


def counters(judgments: DataFrame) -> DataFrame:
    """E-14: what, name, n by label and by rule."""
    return judgments.select(F.explode(F.array(F.struct(F.lit("label").alias("what"), F.col("label").alias("name")), F.struct(F.lit("rule").alias("what"), F.col("rule").alias("name")))).alias("x")).groupBy("x.what", "x.name").agg(F.count("*").alias("n"))


def run_summary(results: DataFrame, by: list[str], latency: str = "latency") -> DataFrame:
    """E-13: sent, failed, tokens and latencies by group; percentiles are the value at place min(n - 1, floor(n * share)), not between two.

    The place is found on counts of equal values, so that a group's values are never listed in one row.
    """
    own = results.where(F.col(latency).isNotNull())
    counts = own.groupBy(*by, F.col(latency).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    placed = counts.withColumn("to", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda share: F.min(F.when(F.col("to") > F.least(F.col("n") - 1, F.floor(F.col("n") * share)), F.col("v")))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), F.round(at(0.5), 3).alias("p50"), F.round(at(0.95), 3).alias("p95"))


def rule_evaluation(items: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """E-15: items (accept, baseline, a boolean column a rule) to rule, accepted, good, conversions, false_positives, recall, precision."""
    each = items.select("accept", "baseline", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("hit")) for r in rules])).alias("x"))
    hit = F.col("x.hit")
    good, accepted = F.count_if(hit & F.col("accept")), F.count_if(hit)
    return each.groupBy(F.col("x.rule").alias("rule")).agg(accepted.alias("accepted"), good.alias("good"), F.count_if(hit & ~F.col("baseline")).alias("conversions"), F.count_if(hit & ~F.col("accept")).alias("false_positives"), F.round(F.try_divide(good, F.count_if(F.col("accept"))), 3).alias("recall"), F.round(good / F.greatest(accepted, F.lit(1)), 3).alias("precision"))


def sense_verdict(norm: Column, variants: Column, intended: Column, others: Column) -> Column:
    """F-35: empty, sense_ok, other_sense or neither, the answer itself and its variants counting alike."""
    forms = F.array_distinct(F.concat(F.array(norm), variants))
    return F.when(F.coalesce(norm, F.lit("")) == "", "empty").when(F.arrays_overlap(forms, intended), "sense_ok").when(F.arrays_overlap(forms, others), "other_sense").otherwise("neither")


def tally(rows: DataFrame, column: str) -> DataFrame:
    """E-16: value, n, percent."""
    n = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def markdown(rows: DataFrame, columns: list[str], title: str) -> str:
    """B-02: a small report's rows as a Markdown table."""
    body = ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows.select(*columns).collect()]
    return "\n".join([f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *body])


def dictionary_stats(records: DataFrame) -> DataFrame:
    """E-11: one row of counts and exact medians over records."""
    return records.agg(
        F.count("*").alias("entries"), F.count_distinct("key").alias("keys"), F.count_if(F.size("translations") > 0).alias("with_translation"), F.sum(F.col("probability_floor").cast("long")).alias("censored"), F.median("n_senses").alias("senses_median"), F.max("n_senses").alias("senses_max"),
        F.median(F.size("translations")).alias("translations_median"), F.max(F.size("translations")).alias("translations_max"), F.sum(F.size("examples")).cast("long").alias("examples"),
    )


def top_values(rows: DataFrame, column: str, n: int) -> DataFrame:
    """W-13: the n most frequent values, of equal ones the first."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def field_profile(rows: DataFrame, column: str) -> DataFrame:
    """E-12: field, n, share of the top-level fields of a JSON column."""
    total = rows.agg(F.count("*").alias("total"))
    fields = rows.select(F.explode(F.json_object_keys(column)).alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    return fields.crossJoin(F.broadcast(total)).select("field", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))  # total: one row
