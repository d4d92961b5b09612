import random

import numpy as np

from lexloom.llm import jaccard


def grams(text, width=5):
    w = (text or "").encode().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def some():
    draw = random.Random(5)
    rows, n = [], 0
    for _ in range(25):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(6, 200))]
        for _ in range(draw.randrange(1, 8)):
            text = list(base)
            for _ in range(draw.randrange(3)):
                text[draw.randrange(len(text))] = f"x{draw.randrange(9999)}"
            rows.append((n * 3 % 1009, " ".join(text)))
            n += 1
    hot = [f"h{k}" for k in range(300)]
    for k in range(60):  # a large group of near copies
        text = list(hot)
        text[(k * 7) % 300] = f"y{k}"
        rows.append((2000 + k, " ".join(text)))
    return rows + [(5001, None), (5002, ""), (5003, ""), (5004, "a b c"), (5005, "a  b\nc"), (5006, rows[0][1]), (5007, rows[0][1])]


def plain(rows, least=0.8):
    sets = [grams(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= least * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    head = {}
    for a in range(len(rows)):
        head[find(a)] = min(head.get(find(a), 1 << 60), rows[a][0])
    return sorted((i, head[find(a)], links[a], i == head[find(a)]) for a, (i, _) in enumerate(rows))


def test_against_plain(spark):
    rows = some()
    docs = spark.createDataFrame([(i, t, 1, "b", 2.0) for i, t in rows], "doc_id long, text string, node int, band string, links double").repartition(3)
    for side, bits in ((256, 64), (8, 4)):  # 4 bits: most nodes clash
        got = jaccard.near_duplicates(docs, side=side, bits=bits).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in got) == plain(rows)


def test_one_of_each_class_stays(spark):
    rows = [*some(), (5006, some()[0][1]), (None, "no id at all in this row"), (None, "no id at all in this row")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, __id string")
    docs = docs.withColumnRenamed("__id", "kept")
    out = jaccard.deduplicated(docs)
    assert out.columns == docs.columns
    want = sum(k for *_, k in plain([r for r in rows if r[0] is not None and r != (5006, rows[0][1])]))
    assert out.count() == want + 1


def test_which_repeated_row_stays(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, v, {"k": v}, "x") for v in ("c", "b", "d")] + [(2, text, "a", {}, "y")], "doc_id long, text string, __id string, m map<string,string>, `__tx` string").repartition(3)
    assert [(r.doc_id, r["__id"], r.m) for r in jaccard.deduplicated(docs).collect()] == [(1, "b", {"k": "b"})]


def test_empty_and_rules(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    limits = jaccard.needed(0.8, 1e-8)
    assert limits[0] == 0 and all(b >= a for a, b in zip(limits, limits[1:], strict=False)) and limits[96] > 40
    sets = [np.unique(np.random.default_rng(k).integers(0, 1 << 63, 500, dtype=np.uint64)) for k in range(3)]
    i, j = jaccard.survivors(jaccard.signatures([sets[0], sets[0][:480], sets[1]]), np.ones((3, 3), bool), 0.8, 1e-8)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1)]


def partners(found, n):
    of = {int(c): i for i, c in enumerate(jaccard.cells(np.arange(n)))}
    rows = found.collect()
    assert len(of) == n and all(of[r.own] == r.node for r in rows)
    return [(r.node, of[c]) for r in rows for c in r.others]


def test_long_chain_stays_linear(spark):
    """Texts that are alike with their neighbours only, so bands join all of them: pairs grow with the texts, not with their square."""
    words = [f"c{k}" for k in range(30 * 700 + 200)]
    texts = [" ".join(words[30 * i : 30 * i + 200]) for i in range(700)]
    bands = jaccard.bands_of(jaccard.signatures(jaccard.shingles(texts)))
    nodes = spark.createDataFrame([(i, [int(x) for x in b]) for i, b in enumerate(bands)], "node long, bands array<long>")
    pairs = partners(jaccard.candidates(nodes, 0.8, 1e-8), len(texts))
    assert len(set(pairs)) == len(pairs) and 100 < len(pairs) < 6 * 700 and max(b - a for a, b in pairs) <= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.class_id == r.doc_id and not r.n_links for r in jaccard.near_duplicates(docs, side=16).collect())


def test_equal_buckets_lose_no_pair(spark):
    """Every pair that shares a band is found once, although equal buckets and all but the first shared band are left out."""
    draw = random.Random(3)
    rows = [(i, [draw.randrange(3) for _ in range(jaccard.BANDS)] if i % 3 else [0] * jaccard.BANDS) for i in range(60)]
    found = partners(jaccard.candidates(spark.createDataFrame(rows, "node long, bands array<long>"), 0.0, 0.0, side=8), 60)
    assert sorted(found) == [(a, b) for a in range(60) for b in range(60) if a != b and any(x == y for x, y in zip(rows[a][1], rows[b][1], strict=True))]
