import random

from lexloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, rank int, _words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 1, "z") for i, t, s in rows], SCHEMA)


def some():
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.choice([1, 5, 40, 300])), ["a", "b", "c", None][min(3, draw.randrange(9) // 2)]) for i in range(400)]
    return rows + [(900, None, "a"), (901, "", "b"), (902, " \t\n", None), (903, "x y z", "é"), (7, "again", "a"), (7, "again", "a"), (None, "no id", "c")]


def plain_targets(sizes, most=3.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (i % 3) + 1.0 for i, s in enumerate(names)}
    full, total = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def test_targets_and_sizes(spark):
    rows = some()
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = plain_targets(sizes)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken == r.copies * r.size and r.taken <= 3 * r.size
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= max(40, 0.05 * want[s]), s
    assert next(r.size for r in got if r.doc_id == 903) == 2


def test_reruns_agree(spark):
    rows = some()
    key = lambda r: (str(r.doc_id), r.tx, r.copies)
    assert sorted(map(key, mixing.mix(docs(spark, rows)).collect())) == sorted(map(key, mixing.mix(docs(spark, rows[::-1]).repartition(5)).collect()))


def test_copies_are_rows(spark):
    rows = some()
    d = docs(spark, rows)
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    copies = {}
    for r in mixing.mix(d).collect():
        copies[r.doc_id, r.tx] = copies.get((r.doc_id, r.tx), 0) + r.copies
    assert out.count() == sum(copies.values())


def test_inclusion_follows_pareto(spark):
    """Over many seeds a document's extra copies come about as often as its inclusion odds say: shorter ones of a stratum more often."""
    rows = [(i, " ".join(["w"] * (64 + i % 10)), "a" if i < 60 else "b") for i in range(120)]
    d = docs(spark, rows).cache()
    taken = {}
    for seed in range(12):
        for r in mixing.mix(d, weights=(1, 1.7), seed=seed).collect():
            taken[r.size] = taken.get(r.size, 0) + r.copies
    assert sum(taken[s] for s in range(64, 67)) > 0.9 * sum(taken[s] for s in range(71, 74))


def test_empty_and_one(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    one = mixing.mix(docs(spark, [(1, "a b", "s")])).first()
    assert (one.copies, one.target) == (1, 2.0)
    assert mixing.mix(docs(spark, [(1, None, None)])).first().copies == 0
