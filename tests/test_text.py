from pyspark.sql import functions as F

from lexloom.functions import japanese as J
from lexloom.functions import scoring as S
from lexloom.functions import text as T
from lexloom.operators import search, terms


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens(spark):
    text = "12 🙂 crème 4b d’accord rock'n'roll -x 𝒴 naïveté"
    docs = spark.createDataFrame([(1, text), (1, "Otters don't hurry."), (2, None), (3, "56 78")], "doc_id long, text string")
    got = [(r.id, r.pos, r.surface, r.offset) for r in terms.located_tokens(docs).collect()]
    assert all(s in (text[o : o + len(s)], "Otters don't hurry."[o : o + len(s)]) for _, _, s, o in got)
    assert sorted(s for _, _, s, _ in got) == sorted(["crème", "4b", "d’accord", "rock'n'roll", "x", "naïveté", "Otters", "don't", "hurry"])
    words = terms.tokens(docs).where("id = 1").collect()
    assert sorted(r.word for r in words) == sorted(["creme", "4b", "d’accord", "rock'n'roll", "x", "naivete", "otters", "don't", "hurry"])
    assert one(spark, None, T.words) == [] and one(spark, "56 78", T.words) == []


def test_token_is_normalised_as_any_string(spark):
    tokens = ["Élan", "İz", "ŸZ", "Œuvre", "ñandú-X", "o'Neill", "d’Été", "ǅ", "ﬁn", "ẞ", "٣x", "A_b", "K"]
    both = spark.createDataFrame([(t,) for t in tokens], "t string").select(T.normalized(F.col("t")).alias("a"), T.normalized_token(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in both)


def test_sentences(spark):
    assert one(spark, "Rain fell? It did!! We left. ", T.sentences) == ["Rain fell?", "It did!!", "We left."]
    assert one(spark, None, T.sentences) == [] and one(spark, "雨。風！\n 雪", T.sentences) == ["雨。", "風！", "雪"]


def test_language(spark):
    assert [one(spark, x, T.language) for x in ("otters swim at dusk", "川で泳ぐ獺", "?!", "", None, "獺 is 川獺です")] == ["en", "ja", "other", "other", "other", "ja"]
    assert one(spark, "abc１２ é 川", T.english_ratio) == 6 / 7 and one(spark, None, T.english_ratio) == 0


def test_words(spark):
    assert all(one(spark, w, T.is_stop_word) for w in ["Because", "hers", "NONETHELESS", "3,141", "", None])
    assert not any(one(spark, w, T.is_stop_word) for w in ["otter", "3rd"])
    assert one(spark, "\u3000Otter  Dam ", T.normalized) == "otter dam" and one(spark, "Brûlée・Z", T.normalized) == "bruleez"


def test_sense_translations(spark):
    assert one(spark, "an animal [-] [translation]: 獺, 川獺 [-] [note]: wet", T.sense_translations) == ["獺", "川獺"]
    assert one(spark, "an animal [-]", T.sense_translations) == [] and one(spark, None, T.sense_translations) == []


def test_japanese(spark):
    n = lambda x: one(spark, x, J.normalized)
    assert n("ＸＹ９") == "xy9" and n("オッター") == n("おった") and n("ダム・ダム") == "だむだむ" and n("川？") == "川" and n(None) == "" and n("Maß") == "mass"
    assert one(spark, "泳ぎを", J.strict) == "泳ぎ"
    for stem, base in (("移動した", "移動"), ("野生的な", "野生的"), ("野生的な", "野生"), ("保護させた", "保護")):
        assert base in one(spark, stem, J.variants)
    assert one(spark, "", J.variants) == [] and len(one(spark, "い" * 40, J.variants)) < 200


def test_scores(spark):
    p = lambda x: one(spark, x, S.idf, "double")
    assert p(1e-7) == 0 and p(1e-5) == 1 and p(0.1) == 1 and p(0.0) is None
    row = spark.createDataFrame([({"a": 1.0, "b": 2.0}, {"b": 1.0}, {})], "x map<string,double>, y map<string,double>, z map<string,double>")
    got = row.select(S.cosine(F.col("x"), F.col("y")).alias("c"), S.cosine(F.col("x"), F.col("z")).alias("d")).first()
    assert abs(got.c - 2 / 5**0.5) < 1e-12 and got.d == 0


def test_search(spark):
    keys = spark.createDataFrame([(k, i) for i, k in enumerate(["cat", "a-cat", "concat", "Cat!", "", "--", "kitten", "sitting"])], "key string, freq_rank long")
    found = lambda *a: [r.key for r in search.search(keys, *a).collect()]
    assert found("contain", "cat") == ["cat", "a-cat", "concat"] and found("containword", "cat") == ["cat", "a-cat"]
    assert found("containcaseword", "CAT") == ["cat", "a-cat", "Cat!"] and found("containword", "-cat") == ["a-cat"]
    assert found("contain*", "\n") == [] and found("containword*", "\n") == ["", "--"] and found("contain", "cat", 1) == ["cat"]
    assert found("edit", "sitting", 2) == ["sitting", "kitten"] and len(found("edit", "x", 0)) == 8
    for bad in ("nope",):
        try:
            found(bad, "x")
        except ValueError:
            continue
        raise AssertionError(bad)
    patterns = spark.createDataFrame([("cat",), ("tt",), ("zzz",)], "pattern string")
    assert sorted(r.key for r in search.batch_contains(keys, patterns).collect()) == ["a-cat", "cat", "concat", "kitten", "sitting"]
