import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import language_model as L


def tokens(text):
    return [bytes(w) for w in bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()] + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def rows_of(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return [*rows, (7001, None), (7002, ""), (7003, "THE the The É é"), (None, "no id here"), (12, "again"), (12, "again")]


def test_base_and_counts(spark, sf):
    rows = rows_of(spark, sf)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, score int, chunk int").repartition(3)
    got = L.fit_and_score(docs).collect()
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    want = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(base(t), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in got)


def plain(rows, table, order):
    """Scores of a model with the given weights, by plain counting."""
    counts, first = [Counter() for _ in range(order + 1)], 0
    padded = lambda t: [0] * (order - 1) + tokens(t)
    for i, t in rows:
        if not held(i):
            w, first = padded(t), first + 1
            for k in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    counts[n][tuple(w[k - n + 1 : k + 1])] += 1
    total, words = sum(counts[1].values()), len(counts[1])

    def score(t):
        w, out = padded(t), 0.0
        for k in range(order - 1, len(w)):
            p = table[0][0] * counts[1][(w[k],)] / total + (1 - table[0][0]) / (words + 1)
            for n in range(2, order + 1):
                context = tuple(w[k - n + 1 : k])
                c = first if k == order - 1 else counts[n - 1][context]
                weight = table[n - 1][math.frexp(c)[1] if c else 0]
                p = weight * (counts[n][(*context, w[k])] / c if c else 0) + (1 - weight) * p
            out += math.log10(p)
        return out

    return score


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_against_plain(spark, sf, monkeypatch, order):
    rows = [r for r in rows_of(spark, sf) if r[0] is not None]
    seen, real = [], L.Model
    monkeypatch.setattr(L, "Model", lambda *a: (seen.append(real(*a)), seen[-1])[1])
    got = L.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order=order).collect()
    score = plain(rows, seen[-1].table, order)
    want = sorted((i, score(t)) for i, t in rows)
    have = sorted((r.doc_id, r.score) for r in got)
    assert [i for i, _ in have] == [i for i, _ in want] and np.allclose([x for _, x in have], [x for _, x in want], atol=1e-6)


def test_weights_rise_with_evidence():
    histogram = np.zeros((L.CONTEXTS, L.BINS))
    histogram[1, 0], histogram[1, L.BINS // 2 + 64] = 90, 10
    histogram[2, 0], histogram[2, L.BINS // 2 + 64] = 10, 90
    w = L.learned(histogram, L._RATIOS[None, :])
    assert 0 < w[1] < w[2] < 1 and w[3] == 0


def test_empty(spark):
    assert L.fit_and_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = L.fit_and_score(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert (one.n_tokens, one.n_known, one.train_tokens) == (1, 1, 1)
