"""Senses told apart by an example, sample stores, stop words of two languages."""

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import evaluation as E


def senses(*rows):
    return [{"pos": "noun", "text": t, "label": "s", "translations": list(tr)} for t, tr in rows]


SENSES = "array<struct<pos:string,text:string,label:string,translations:array<string>>>"


def test_sense_example(spark):
    rows = [("a tool e.g.: The crane lifts. [-] more",), ("e.g.:a crane",), ("no example",), (None,), ("e.g.: two\nlines",)]
    got = spark.createDataFrame(rows, "t string").select(E.sense_example(F.col("t")).alias("e")).collect()
    assert [r.e for r in got] == ["The crane lifts.", "a crane", "", "", "two\nlines"]


def test_polysemous(spark):
    good = senses(("e.g.: A Crane flew. [-]", ["鶴"]), ("e.g.: The crane lifts.", ["起重機"]), ("none", ["x"]))
    same = senses(("e.g.: A crane flew.", ["鶴", "つる"]), ("e.g.: a crane", ["つる", "鶴", "鶴"]), ("none", ["x"]))
    other = senses(("e.g.: Cranes flew.", ["鶴"]), ("e.g.: a crane", []), ("e.g.: crane", ["鶴"]))
    rows = [("crane", 4000, good), ("crane", 4001, same), ("crane", 4002, other), ("crane", 10, good), ("with", 4003, good), ("a.b", 4004, good), ("crane", 4005, good[:2])]
    records = spark.createDataFrame([(w, r, len(s), ["t"], s) for w, r, s in rows], f"word string, freq_rank long, n_senses int, translations array<string>, senses {SENSES}")
    got = E.polysemous(records).collect()
    assert [(r.word, r.freq_rank, [(u["index"], u.example) for u in r.usable]) for r in got] == [("crane", 4000, [(0, "A Crane flew."), (1, "The crane lifts.")])]


def test_replace_set(spark):
    old = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "set_id string, headword string")
    new = spark.createDataFrame([("a", "w")], "set_id string, headword string")
    assert sorted(map(tuple, E.replace_set(old, new).collect())) == [("a", "w"), ("b", "z")]


def test_stop_words(spark):
    rows = spark.createDataFrame([("The",), ("の",), ("12",), ("",), (None,), ("川",)], "w string")
    w = F.col("w")
    got = rows.select(*[T.is_stop_word(w, x).alias(x) for x in ("en", "ja", "fr")]).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, False), (True,) * 3, (True,) * 3, (True,) * 3, (False,) * 3]
