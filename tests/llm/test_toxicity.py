import random

import numpy as np

from lexloom.llm import toxicity


def corpus(n=600, seed=1):
    draw = random.Random(seed)
    rude, rows, labels = ["grumble", "snarl", "scoff"], [], []
    for i in range(n):
        words = [f"w{draw.choice('abcdefgh')}{draw.choice('abcdefgh')}{draw.choice('abc')}" for _ in range(draw.randrange(5, 60))]
        bad = i % 6 == 0
        for _ in range(draw.randrange(1, 4) if bad else 0):
            words.insert(draw.randrange(len(words)), draw.choice(rude) + draw.choice(["", "s", "ing"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    rows += [(9001, None), (9002, ""), (None, "snarl"), (3, "a second row"), (9003, "snarling " * 30000)]
    docs = spark.createDataFrame([(i, t, "q", 0.5, "l") for i, t in rows], "doc_id long, text string, source string, score double, toxic string")
    known = spark.createDataFrame([*labels, (7, None), (None, 1), (8, 0), (8, 0)], "doc_id long, toxic int")
    index = toxicity.fit(docs, known)
    got = {}
    for r in toxicity.score(docs, index).collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and len(r.neighbours) == len(r.cosines)
        got[r.doc_id] = r
    truth = dict(labels)
    right = [got[i].predicted == truth[i] for i in truth if i != 3]
    assert np.mean(right) > 0.97 and got[9001].predicted == got[9002].predicted == 0 and got[9003].predicted == 1
    kept = toxicity.clean(docs, index)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in toxicity.score(docs, index).collect())


def dense(index):
    """The examples' unit vectors as rows of a matrix."""
    out = np.zeros((len(index.ids), len(index.weight)))
    for i in range(len(index.ids)):
        at, w = index.of_example(i)
        out[i, at] = w
    return out


def test_block_max_is_exact():
    draw = np.random.default_rng(4)
    words = ["".join(draw.choice(list("abcdefgh"), 3)) + f"x{'y' * i}" for i in range(40)]
    size = draw.integers(1, 7, 500)
    first = np.concatenate([[0], np.cumsum(size)])
    place = np.concatenate([draw.choice(40, n, replace=False) for n in size])
    index = toxicity.Index("\n".join(words), draw.uniform(1, 4, 40), np.arange(500), draw.integers(0, 2, 500).astype(float), np.ones(500), first, place, draw.integers(1, 4, len(place)), 0.1, k=7, block=16)
    every = dense(index)
    for _ in range(60):
        at, w = index.vector(" ".join(draw.choice(words, 3, replace=False)))
        cosines = every[:, at] @ w
        best, cosine = index.nearest(at, w)
        assert np.allclose(cosine, np.sort(cosines)[::-1][:7][: len(cosine)]) and np.allclose(cosines[best], cosine) and (len(cosine) == 7 or (cosines > 0).sum() == len(cosine))
    order = toxicity.arranged(first, place, np.ones(len(place)), 40, 16)
    assert sorted(order.tolist()) == list(range(500))


def steps(x, y, w):
    """Isotonic regression by its max-min formula."""
    at = sorted(set(x))
    mean = lambda a, b: (lambda m: float((y[m] * w[m]).sum() / w[m].sum()))((x >= a) & (x <= b))
    return at, [max(min(mean(a, b) for b in at if b >= c) for a in at if a <= c) for c in at]


def test_against_plain(spark):
    """The whole score: all words as terms, weights from all labelled rows, exact neighbours, votes, calibration by leave-one-out."""
    rows, labels = corpus(260, 7)
    rows += [(900, ""), (901, None), (902, "wholly unseen wordlets"), (903, rows[0][1]), (904, rows[6][1] + " " + rows[1][1])]
    labels += [(900, 0), (901, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), k=5)
    words = lambda t: toxicity.Counter(toxicity.re.findall(r"[^\W\d_]+", (t or "").lower()))
    truth, text = dict(labels), dict(rows)
    train = [i for i in truth if toxicity.zlib.crc32(str(i).encode()) % 5]
    n, positive = len(train), sum(truth[i] for i in train)
    sets = {i: set(words(text[i])) for i in train}
    own = [i for i in index.ids.tolist()]  # in the index's order, which breaks ties
    assert sorted(own) == sorted(i for i in train if sets[i])  # no near copies among them
    vocabulary = sorted(set().union(*sets.values()))
    assert sorted(index.words.split("\n")) == vocabulary

    def weight(t):
        told = 0.0
        for has in (True, False):
            for y in (0, 1):
                cell, a, b = sum((t in sets[i]) == has and truth[i] == y for i in train), sum((t in sets[i]) == has for i in train), sum(truth[i] == y for i in train)
                told += cell / n * np.log(cell * n / (a * b)) if cell else 0.0
        return (np.log((1 + n) / (1 + sum(t in sets[i] for i in train))) + 1) * np.sqrt(max(1e-12, told))

    of = {t: weight(t) for t in vocabulary}

    def vector(t):
        v = {w: (1 + np.log(k)) * of[w] for w, k in words(t).items() if w in of}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = [vector(text[i]) for i in own]
    bare = [i for i in train if not sets[i]]
    empty = (sum(truth[i] for i in bare) + positive / n) / (len(bare) + 1)

    def raw(v, without=None):
        cosines = [(-round(sum(x * e.get(w, 0.0) for w, x in v.items()), 12), j) for j, e in enumerate(examples) if j != without]
        best = [(-c, truth[own[j]]) for c, j in sorted(cosines)[:5] if c < 0]
        return (sum(c * c * y for c, y in best) + empty) / (sum(c * c for c, _ in best) + 1) if best else empty

    x = np.array([*[raw(e, j) for j, e in enumerate(examples)], empty])
    at, step = steps(np.round(x, 13), np.array([*[float(truth[i]) for i in own], empty]), np.array([1.0] * len(own) + [float(max(1e-9, len(bare)))]))
    for r in toxicity.score(docs, index).collect():
        want = raw(vector(text[r.doc_id]))
        want = 0.98 * float(np.interp(want, at, step)) + 0.02 * want
        assert abs(r.score - want) < 1e-6, (r.doc_id, r.score, want)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0, 0, 0.5, 0.5, 1, 1] and x.tolist() == [1, 1, 2, 3, 4, 4]


def test_weights_come_from_all_labelled_rows(spark):
    """Document frequencies are those of all labelled rows, though few are examples; every word of an example is a term."""
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("abcdefghij") * 3 for _ in range(20)) + (" grumble" if i % 3 == 0 else "") + f" only{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}") for i in range(3000)]
    index = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"), per_class=40)
    assert len(index.ids) == 80 and len(index.weight) == 80 + 11
    of_all = [i for i in range(3000) if toxicity.zlib.crc32(str(i).encode()) % 5]
    with_it = sum(i % 3 == 0 for i in of_all)
    told = toxicity.information(np.array([float(with_it)]), np.array([float(with_it)]), len(of_all), with_it)[0]
    assert abs(index.weight[index.words.split("\n").index("grumble")] - (np.log((1 + len(of_all)) / (1 + with_it)) + 1) * np.sqrt(told)) < 1e-9


def test_likely_loses_no_row(spark):
    known = spark.range(0, 90_000, 7).withColumnRenamed("id", "doc_id")
    docs = spark.range(100_000).selectExpr("id as doc_id", "'x' as text").unionByName(spark.sql("select cast(null as long) as doc_id, 'y' as text"))
    got = {r.doc_id for r in toxicity.likely(docs, known, known.count()).collect()}
    assert set(range(0, 90_000, 7)) <= got and len(got) < 40_000
    assert toxicity.likely(docs, known.limit(0), 0).count() == 0
    assert set(range(0, 90_000, 7)) <= {r.doc_id for r in toxicity.likely(docs, known, known.count(), most=1 << 10).collect()}


def test_only_verified_copies_go_and_places_fill_up(spark):
    draw = random.Random(5)
    base = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    same_words = [(i, " ".join(draw.sample(base, 60))) for i in range(40)]  # one vocabulary, no common passages
    text = " ".join(draw.choice(base) for _ in range(200))
    copies = [(100 + i, f"{text} {base[i % 60]}") for i in range(60)]
    docs = spark.createDataFrame(same_words + copies, "doc_id long, text string")
    known = spark.createDataFrame([(i, 0) for i, _ in same_words + copies], "doc_id long, toxic int")
    got = {r.doc_id for r in toxicity.examples(docs, known, {0: 100}, 30).collect()}
    assert len(got) == 30 and sum(i >= 100 for i in got) <= 1
    every = {r.doc_id for r in toxicity.examples(docs, known, {0: 100}, 100).collect()}
    assert set(range(40)) <= every and len(every) == 41
