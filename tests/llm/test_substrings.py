import hashlib
import random

import pytest

from lexloom.llm import substrings


def plain(rows, width):
    first, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: 1 << 63 if i is None else i
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, 1 << 63), order(i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < order(i):
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def some(seed=1):
    draw = random.Random(seed)
    word = lambda n=400: f"w{draw.randrange(n)}"
    passage, line = [word() for _ in range(90)], [word() for _ in range(70)]
    rows = []
    for i in range(120):
        text = [word() for _ in range(draw.randrange(1, 160))]
        if i % 3 == 0:
            text[len(text) // 2 : len(text) // 2] = passage[draw.randrange(20) : 90 - draw.randrange(20)]
        if i % 4 == 0:
            text = line + text
        rows.append((i * 2, " ".join(text)))
    rows += [(501, rows[0][1]), (502, rows[3][1].replace(" ", "\n", 7)), (503, None), (504, ""), (505, "a"), (3, rows[9][1]), (3, rows[9][1]), (3, rows[12][1]), (None, rows[3][1]), (506, " ".join(["same"] * 400)), (507, " ".join(["same"] * 300)), (508, "é x y " * 60), (509, "é x y " * 70)]
    return rows


@pytest.mark.parametrize(("width", "bucket"), [(50, substrings.BUCKET), (50, 1), (7, 2), (1, 5)])
def test_against_plain(spark, width, bucket):
    rows = some()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, order int").repartition(4)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed(docs, width, bucket).collect()), key=repr)
    assert got == plain(rows, width) and sum(r[2] for r in got) > 0


def test_texts_change_only_where_words_go(spark):
    rows = some()
    docs = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in rows], "doc_id long, text string, n_chars int, starts string")
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == len(rows)
    before = {(i, t) for i, t in rows}
    for r in out.collect():
        assert r.n_chars == len(r.text or "") and ((r.doc_id, r.text) in before or "\n" not in r.text)


def test_other_names(spark):
    rows = some()
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d", 7) for i, t in rows], "doc_id long, body string, text string, __o string, __t string, __starts string, __new int")
    out = substrings.without_repeats(docs, text="body")
    same = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.dtypes == docs.dtypes and {(r.text, r["__o"], r["__starts"], r["__new"]) for r in out.collect()} == {("a", "b", "d", 7)}
    assert sorted(((r.doc_id, r.body) for r in out.collect()), key=repr) == sorted(((r.doc_id, r.text) for r in same.collect()), key=repr)


def test_empty(spark):
    assert substrings.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
