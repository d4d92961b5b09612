import json
import time

import pytest
from pyspark.sql import functions as F

from lexloom.operators import evaluation as E
from lexloom.operators import lexicon, meanings, terms
from lexloom.plans import fixtures as V
from lexloom.plans.reports import fixture_links
from lexloom.sources import hashdbm
from lexloom.streaming import runs


def number(n):
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def table(path, buckets, records):
    """records: (key, value), None removes; later ones come first in their chain."""
    width, align, at = 4, 3, 4096
    heads, body = [0] * buckets, b""
    for key, value in records:
        b = hashdbm.bucket_of(key, buckets)
        kind = hashdbm.REMOVE if value is None else hashdbm.SET
        record = bytes([kind | 5]) + (heads[b] >> align).to_bytes(width, "big") + number(len(key)) + number(len(value or b"")) + number(0) + key + (value or b"")
        heads[b] = at + len(body)
        body += record + b"\0" * (-len(record) % (1 << align))
    meta = bytearray(128)
    meta[:9] = b"LoomHash\n"
    meta[12], meta[13], meta[14] = 1, width, align
    for place, n in ((16, buckets), (24, len(records)), (40, at + len(body))):
        meta[place : place + 8] = n.to_bytes(8, "big")
    data = bytes(meta) + b"".join((h >> align).to_bytes(width, "big") for h in heads)
    path.write_bytes(data.ljust(at, b"\0") + body)


def test_hashes():
    assert {k: f"{hashdbm.murmur(k.encode()):016X}" for k in ("", "a", "hello", "tightening", "0123456789abcdef")} == {"": "55B11E5415198C8D", "a": "9244A1E6E9FAA9BF", "hello": "38C5E7D713FD6BD6", "tightening": "CEA9B7026C7E5B82", "0123456789abcdef": "851C8A4996F181DC"}
    assert hashdbm.bucket_of(b"any", 1) == 0


def test_hash_dictionary(spark, tmp_path):
    path = tmp_path / "tiny.tkh"
    table(path, 2, [(b"run", b"old"), (b"run", b"[1]"), (b"bank", b"x" * 300), (b"gone", b"y"), (b"gone", None), (b"river", b"{}")])
    spark.dataSource.register(hashdbm.HashDictionary)
    rows = {bytes(r.key): bytes(r.value) for r in spark.read.format("hashdbm").load(str(path)).collect()}
    assert rows == {b"run": b"[1]", b"bank": b"x" * 300, b"river": b"{}"}
    assert [bytes(r.value) for r in spark.read.format("hashdbm").option("key", "run").load(str(path)).collect()] == [b"[1]"]
    assert spark.read.format("hashdbm").option("key", "gone").load(str(path)).count() == 0
    with_magic = spark.read.format("hashdbm").option("magic", "LoomHash\\n")
    assert with_magic.load(str(path)).count() == 3
    with pytest.raises(Exception, match="not a hash dictionary"):
        spark.read.format("hashdbm").option("magic", "LoomHush\\n").load(str(path)).count()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for key, n in (("run", 1), ("gone", 0)):
            found = with_magic.option("pushdown", "true").load(str(path)).where(F.col("key") == F.lit(key).cast("binary"))
            assert found.count() == n
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    asked = hashdbm._PushReader({"path": str(path)})
    assert list(asked.pushFilters([hashdbm.EqualTo(("key",), b"run"), hashdbm.EqualTo(("key",), b"x")])) == [hashdbm.EqualTo(("key",), b"x")]
    assert list(asked.read(asked.partitions()[0])) == [(b"run", b"[1]")]
    t = hashdbm.Table(str(path))
    assert b"run" in t and b"gone" not in t and t.header.records == 6 and t.header.base % 4096 == 0
    (tmp_path / "bad").write_bytes(b"\0" * 200)
    with pytest.raises(ValueError):
        hashdbm.Table(str(tmp_path / "bad"))


def test_key_list(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("the\n\nof\n  \nand\n")
    rows = lexicon.with_rank(spark.read.text(str(tmp_path / "keys.txt"))).orderBy("freq_rank").collect()
    assert [(r.key, r.freq_rank) for r in rows] == [("the", 0), ("of", 1), ("and", 2)]


def test_bad_json_gives_no_entry(spark):
    raw = spark.createDataFrame([("a", 0, "{oops"), ("b", 1, "[{}]"), ("c", None, None)], "key string, freq_rank long, raw string")
    rows = lexicon.entries(raw).collect()
    assert [(r.key, r.word, r.pos, r.prob, r.translations) for r in rows] == [("b", "b", "unkpos", 0.0, [])]


def test_context_helps(spark):
    scored = meanings.scored_records(lexicon.entries(V.raw_lexicon(spark)))
    got = meanings.resolve(spark.createDataFrame(V.CONTEXTS, "id long, word string, context string"), scored, V.inflections(spark)).collect()
    top = {r.id: (r.ja, r.score) for r in got if r.nth == 1}
    assert top[1][0] == "土手" and top[2][0] == "銀行" and top[3][1] > top[4][1] and 5 not in top and top[6][0] == "マウス"
    for i in top:
        assert sum(r.id == i for r in got) <= 8


def test_cap_of_context_words(spark):
    words = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    raw = [(w, i, json.dumps([{"word": w, "probability": ".1", "related": ["new" + w, "other" + w]}])) for i, w in enumerate(words)]
    records = lexicon.entries(spark.createDataFrame(raw, "key string, freq_rank long, raw string"))
    c = spark.createDataFrame([(1, " ".join(words[:62])), (2, " ".join(words[:64])), (3, " ".join(words))], "id long, context string")
    got = {r.id: r.features for r in meanings.context_features(c, records, spark.createDataFrame([], "id long, word string")).collect()}
    assert len(got[1]) == 64 and len(got[2]) == 65 and len(got[3]) == 71 and got[3]["newqaa"] == 0.5


def test_quantiles(spark):
    rows = spark.createDataFrame([(i,) for i in range(100)], "freq_rank long")
    assert [r["count"] for r in E.quantiles(rows, 10).groupBy("quantile").count().collect()] == [10] * 10
    few = {r.freq_rank: r.quantile for r in E.quantiles(spark.createDataFrame([(i,) for i in (5, 9, 100, 101, 500)], "freq_rank long"), 2).collect()}
    assert [few[k] for k in sorted(few)] == sorted(few.values())
    assert E.quantiles(rows.limit(0), 5).count() == 0 and all(0 <= r.quantile < 20 for r in E.quantiles(rows.limit(3), 20).collect())


def test_sample_is_stable(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(60)], "k long, s long")
    a = sorted(r.k for r in E.sample(rows, ["s"], 5, "k", 1).collect())
    assert a == sorted(r.k for r in E.sample(rows.repartition(7), ["s"], 5, "k", 1).collect()) and len(a) == 15
    assert a != sorted(r.k for r in E.sample(rows, ["s"], 5, "k", 2).collect())


def test_resolver_only_adds(spark):
    links = fixture_links(spark)
    probes = V.probes(spark)
    bare = {r.probe_id: r.label for r in E.judge(probes, links).collect()}
    expanded = lexicon.expand_glosses(links.drop("norm")).withColumn("norm", F.col("gloss"))
    wide = {r.probe_id: r.label for r in E.judge(probes, links, None, expanded, lexicon.synonyms(links.drop("norm"))).collect()}
    assert all(wide[i] == bare[i] or (bare[i], wide[i]) == ("X", "P") for i in bare) and wide != bare
    again = E.judge(probes, links, spark.createDataFrame([(i, "j2") for i in bare], "probe_id long, judge_ver string"))
    assert again.count() == 0


def test_expansion_holds_own_glosses(spark):
    links = fixture_links(spark).drop("norm")
    wide = {(r.word, r.gloss) for r in lexicon.expand_glosses(links).collect()}
    assert {(r.word, r.gloss) for r in links.collect()} <= wide
    assert lexicon.expand_glosses(links, extra_limit=1).where("extra").groupBy("word").count().where("count > 1").count() == 0


def test_ask_retries(spark):
    def client():
        tries = {}

        def call(prompt):
            tries[prompt] = tries.get(prompt, 0) + 1
            if prompt == "bad" or tries[prompt] < 2:
                raise RuntimeError("busy")
            return {"text": prompt.upper(), "tokens_in": 1, "tokens_out": 1}

        return call

    began = time.time()
    rows = {r.prompt: r for r in E.ask(spark.createDataFrame([("ok",), ("bad",)], "prompt string"), client, 2, 0.01).collect()}
    assert rows["ok"].raw_output == "OK" and rows["bad"].raw_output is None and "busy" in rows["bad"].parsed_json and time.time() - began < 60


def test_probe_cache(spark):
    plan = spark.createDataFrame([("s", w, "m", "P1", "v") for w in ("a", "b", "b", "c")], ",".join(f"{k} string" for k in E.PROBE_KEY))
    stored = spark.createDataFrame([("s", "a", "m", "P1", "v", "x", None), ("s", "c", "m", "P1", "v", None, '{"error":"e"}')], ",".join(f"{k} string" for k in E.PROBE_KEY) + ",raw_output string,parsed_json string")
    assert sorted(r.headword for r in E.pending(plan, stored).collect()) == ["b"]
    again = E.pending(plan, stored, True)
    assert sorted(r.headword for r in again.collect()) == ["b", "c"]
    new = again.withColumns({"raw_output": F.lit("new"), "parsed_json": F.lit(None).cast("string")})
    assert sorted((r.headword, r.raw_output) for r in E.upsert(stored, new).collect()) == [("a", "x"), ("b", "new"), ("c", "new")]


def test_audit_without_version_counts_twice(spark):
    once = E.audit_summary(V.tasks(spark), V.judgments(spark)).first()
    assert E.audit_summary(V.tasks(spark), V.judgments(spark), None).first().audited == 2 * once.audited


def test_report_written_and_read(spark, tmp_path):
    judged = E.load_judgments(V.probes(spark), V.judgments(spark), V.samples(spark))
    assert judged.count() == E.load_judgments(V.probes(spark), V.judgments(spark), V.samples(spark), layer="main").count() + 1
    E.curve(judged).orderBy("quantile").coalesce(1).write.csv(str(tmp_path / "c"), header=True)
    back = spark.read.csv(str(tmp_path / "c"), header=True, inferSchema=True)
    assert back.count() == 5 and back.columns == E.curve(judged).columns
    text = E.markdown(E.curve(judged).orderBy("quantile"), ["quantile", "n", "strict"], "Curve")
    assert text.startswith("# Curve") and text.count("\n") == 8
    assert E.overall(judged.limit(0)).first().strict == 0.0


def test_stream(spark, tmp_path, sf):
    schema = spark.read.parquet(f"{sf}/benchmark.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/benchmark.parquet").repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("the",)], "word string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    runs.per_batch(stream, lambda d: terms.unknown_words(d, known, "item_id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = terms.unknown_words(spark.read.parquet(f"{sf}/benchmark.parquet"), known, "item_id")
    key = lambda r: (r.id, r.unknown, r.words)
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(key, batch.collect()))
