"""The facade gives what the operators give."""

from lexloom.facade import Lexicon
from lexloom.plans import fixtures as V
from lexloom.plans import lexical
from lexloom.plans.registry import QUERIES


def rows(df):
    return sorted(map(repr, df.collect()))


def test_facade(spark, sf):
    own = Lexicon(V.raw_lexicon(spark), V.inflections(spark))
    texts = lexical.fixture_texts(spark)
    assert rows(own.resolve(lexical.contexts(spark))) == rows(QUERIES["q03_resolve"](spark, sf))
    assert rows(own.enrich(texts)) == rows(QUERIES["q04_enrich"](spark, sf))
    assert rows(own.hints(texts)) == rows(QUERIES["b03_hints"](spark, sf))
    words = lexical.words(spark)
    found = {r.word: r.lemma for r in own.lookup(words).collect()}
    assert found["ran"] == "run" and found["mice"] == "mouse" and found["xyzzy"] is None
    assert {r.word for r in own.contains(words).collect()} == {w for w in V.WORDS if w.strip().lower() in dict(V.LEXICON)}
    assert [r.key for r in own.search("begin", "tight").collect()] == ["tighten", "tightening"]
    assert {r.word for r in own.extract(texts).where("id = 2").collect()} >= {"doctor"}
    assert own.compact().count() == own.records.count() == own.domains().count()
