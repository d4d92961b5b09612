import hashlib

import numpy as np

from lexloom.llm import digest


def test_entropies():
    x = np.random.default_rng(0).integers(97, 110, 700).astype(np.uint8)
    full = 64 * 6 << 20
    for i, e in enumerate(digest.entropies(x)):
        counts = np.unique(x[i : i + 64], return_counts=True)[1]
        assert e == (full - sum(digest._BITS_OF[c] for c in counts)) * 1000 // full


def test_batches_do_not_matter():
    draw = np.random.default_rng(1)
    texts = [bytes(draw.integers(97, 123, n).astype(np.uint8)) for n in (0, 1, 63, 64, 65, 128, 1000, 20000, 200_000)]
    rank = digest.ranks(digest.histogram(texts))
    together = digest.filters(texts, rank)
    for t, c in zip(texts, together, strict=True):
        assert (digest.filters([t], rank)[0] == c).all() and (digest.chain_of(digest.text_of(c)) == c).all()
    assert len(together[0]) == 0 and len(together[-1]) > 1
    assert digest.likeness(together[-1], together[-1]) == 1 and digest.likeness(together[0], together[0]) == 1 and digest.likeness(together[0], together[3]) == 0
    assert digest.likeness(together[7], together[6]) < 0.2


def test_query_shape(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(10_000, None), (10_001, ""), (10_002, "é🙂x" * 50), (5, "a second text of this id"), (None, "without id")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, __range int").drop("__range")
    got = digest.compare_with_edited(docs.repartition(5)).collect()
    assert len(got) == len(rows)
    tx = {}
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True)
    order = [(i, t or "") for i in [*ids, None] for j, t in rows if i == j and i != 5]
    single = {i: t for i, t in order}
    for r in got:
        if r.doc_id == 5 or r.doc_id is None or ids[ids.index(r.doc_id) - len(ids) + 1] == 5 or ids.index(r.doc_id) == len(ids) - 1:
            continue
        text, other = single[r.doc_id], single[ids[ids.index(r.doc_id) + 1]]
        k = len(text) // 3
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - k] + other[:k]).encode()).hexdigest()
        assert tx.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    last = next(r for r in got if r.doc_id is None)
    head = single[ids[0]]
    k = len("without id") // 3
    assert last.edited_sha256 == hashlib.sha256(("without id"[: 10 - k] + head[:k]).encode()).hexdigest()
    long = [r for r in got if r.n_chars > 2000]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.3


def test_small_tables(spark):
    assert digest.compare_with_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = digest.compare_with_edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1
