import numpy as np

from lexloom.llm import forest


def test_recall_and_precision(spark):
    draw = np.random.default_rng(2)
    base = draw.standard_normal((900, 32))
    near = [b + draw.standard_normal(32) * s for b, s in zip(base[:300], np.linspace(0.02, 0.3, 300), strict=True)]
    group = base[5] + draw.standard_normal((250, 32)) * 0.02
    x = np.concatenate([base, near, group, base[10:20]])
    rows = [(i, list(map(float, v)), "l") for i, v in enumerate(x)]
    rows += [(5000, None, "l"), (5001, [], "l"), (5002, [0.0] * 32, "l"), (5003, [float("nan")] * 32, "l"), (5004, [1.0] * 31 + [float("inf")], "l"), (5005, [None] * 32, "l"), (None, rows[0][1], "l"), (5006, [1.0, 2.0], "l"), (5007, [2.0, 4.0], "l"), (5008, [v * 1e30 for v in rows[30][1]], "l")]
    got = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string").repartition(3), sample=500, leaf=64).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    whole = np.concatenate([x, x[30:31]])
    unit = whole / np.linalg.norm(whole, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    degree = linked.sum(axis=1)
    mine = np.array([by[i].n_links for i in range(len(x))] + [by[5008].n_links])
    assert (mine <= degree).all() and mine.sum() >= 0.97 * degree.sum()
    for i in (5000, 5001, 5002, 5003, 5004, 5005):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[None].n_links == 0 and not by[None].kept and by[5006].n_links == by[5007].n_links == 1 and by[5007].component_id == 5006
    assert by[5008].component_id == by[30].component_id and all(by[i].kept == (by[i].component_id == i) for i in range(len(x)))


def test_empty(spark):
    assert forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert forest.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).first().component_id == 1


def test_loose_group_keeps_its_links():
    """A third of the vectors in a group of mean cosine 0.9, at a depth for 200,000 rows."""
    draw = np.random.default_rng(0)
    x = draw.standard_normal((9000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:3000] = np.sqrt(0.9) * x[-1] + np.sqrt(0.1) * x[:3000]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x[:3000] @ x[:3000].T >= 0.95, 1))
    assert len(a) > 100
    leaves = [set(v) for v in forest.Forest(x, 200_000).place(x)]
    assert all(leaves) and np.mean([bool(leaves[i] & leaves[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.98
