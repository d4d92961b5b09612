from pyspark.sql import functions as F

from lexloom.llm import rollups

from compare import same

SCHEMA = "op string, text string, source string, lang string, old_text string, old_source string, old_lang string, docs int, tokens string"


def changes(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def totals(store, version="words-1"):
    return {(r.source, r.lang): (r.docs, r.tokens) for r in store.totals().where(F.col("version") == version).collect()}


def test_batches(spark, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "store"))
    assert store.totals().count() == 0
    first = changes(spark, [("insert", "a b c", "s", "en", None, None, None), ("insert", "d", "s", "en", None, None, None), ("insert", None, None, None, None, None, None), ("insert", "", "t", "de", None, None, None)])
    assert store.commit("1", first) and not store.commit("1", first)
    assert totals(store) == {("s", "en"): (2, 4), (None, None): (1, 0), ("t", "de"): (1, 0)}
    assert store.commit("2/é", changes(spark, [("revise", "a b", "s2", "en", "a b c", "s", "en"), ("delete", "", "t", "de", None, None, None)]))
    assert store.committed("2/é") and not store.committed("3")
    assert totals(store) == {("s", "en"): (1, 1), ("s2", "en"): (1, 2), (None, None): (1, 0)}
    assert store.commit("none", changes(spark, [])) and totals(store)["s", "en"] == (1, 1)
    assert store.commit("again", changes(spark, [("insert", "a b", "s2", "en", None, None, None)]), {"bytes-1": lambda t: F.octet_length(t)})
    assert totals(store, "bytes-1") == {("s2", "en"): (1, 3)} and totals(store)["s2", "en"] == (1, 2)


def test_two_writers_of_one_batch(spark, tmp_path):
    """Both find the batch missing and write; one counts, whichever marks first."""
    store, other = rollups.Rollup(spark, str(tmp_path / "store")), rollups.Rollup(spark, str(tmp_path / "store"))
    rows = changes(spark, [("insert", "a b c", "s", "en", None, None, None)])
    assert not store.committed("31") and not other.committed("31")
    first, second = store.prepare(rows), other.prepare(rows)
    assert totals(store) == {}
    assert other.mark("31", second) and not store.mark("31", first)
    assert totals(store) == totals(other) == {("s", "en"): (1, 3)}
    assert not store.commit("31", rows) and totals(store) == {("s", "en"): (1, 3)}


def test_marker_of_a_dead_writer(spark, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "store"))
    rows = changes(spark, [("insert", "a b c", "s", "en", None, None, None)])
    assert store.commit("1", rows)
    (tmp_path / "store/committed" / b"2".hex()).write_text("half a na")
    assert not store.committed("2") and totals(store) == {("s", "en"): (1, 3)}
    assert store.commit("2", rows) and totals(store) == {("s", "en"): (2, 6)}


def test_bad_change(spark, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "store"))
    for rows in ([("oops", "a", "s", "en", None, None, None)], [(None, "a", "s", "en", None, None, None)]):
        try:
            store.commit("x", changes(spark, rows))
        except Exception:  # noqa: BLE001
            assert not store.committed("x")
            continue
        raise AssertionError


def test_query(spark, sf):
    same(rollups.query(spark, sf), rollups.SQL, sf)
