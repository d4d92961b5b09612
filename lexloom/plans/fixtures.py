"""A small lexicon, texts and probes of our own, as rows for queries and as SQL for their twins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _entry(word, probability, translation, related=(), cooccurrence=(), item=(), example=(), **more):
    return {"word": word, "probability": probability, "translation": list(translation), "related": list(related), "cooccurrence": list(cooccurrence), "item": [{"pos": p, "label": "s", "text": t} for p, t in item], "example": [{"e": e, "j": j} for e, j in example], **more}


#: key and its entries, in order of frequency.
LEXICON = [
    ("run", [_entry("run", ".0004", ["走る", "経営する"], ["race", "sprint", "operate"], ["home", "business", "mile"], [("verb", "move fast on foot [-] [translation]: 走る, 駆ける"), ("verb", "direct a business [-] [translation]: 経営する")], [("She runs every day.", "彼女は毎日走る。")])]),
    ("bank", [_entry("bank", ".0001", ["銀行", "土手", "堤防"], ["money", "riverbank", "loan", "shore"], ["account", "river", "deposit"], [("noun", "an institution that keeps money 銀行 deposits and loan [-] [translation]: 銀行"), ("noun", "sloping land beside a river 土手 shore water [-] [translation]: 土手, 川岸 [-] [synonym]: riverside")], [("He sat on the bank of the river.", "彼は川の土手に座った。")], pronunciation="bæŋk")]),
    ("money", [_entry("money", ".00015", ["お金", "金銭"], ["cash", "currency", "loan"], ["bank", "spend"], [("noun", "currency used as a medium of exchange money [-] [translation]: お金")])]),
    ("river", [_entry("river", ".00006", ["川", "河川"], ["riverside", "shore", "water"], ["bank", "flow"], [("noun", "a large natural stream of water [-] [translation]: 川")], [("The river is wide.", "川は広い。")])]),
    ("doctor", [_entry("doctor", ".00008", ["医者", "博士"], ["physician", "nurse"], ["hospital", "patient"], [("noun", "a person who treats patients in a hospital or clinic [-] [translation]: 医者")])]),
    ("server", [_entry("server", ".00003", ["サーバー", "給仕人"], ["computer", "client"], ["network", "web"], [("noun", "a computer that serves a network of client software [-] [translation]: サーバー")])]),
    ("policy", [_entry("policy", ".00007", ["政策", "方針"], ["plan", "strategy"], ["monetary", "foreign"], [("noun", "a plan of action [-] [translation]: 政策")])]),
    ("tighten", [_entry("tighten", ".000008", ["締める", "引き締める"], ["squeeze", "restrict"], ["policy", "belt"], [("verb", "make tight [-] [translation]: 締める")], [("They tightened the rope.", "彼らは縄を締めた。")])]),
    ("tightening", [_entry("tightening", ".0000185", ["締め付け", "引き締め"], ["contraction", "restriction", "policy"], ["monetary", "fed"], [("noun", "the act of making a policy tight 引き締め money market [-] [translation]: 引き締め, 締め付け [-] [synonym]: contraction")], [("Monetary tightening hurts growth.", "金融引き締めは成長を損なう。")])]),
    ("japan", [_entry("Japan", ".0002", ["日本"], ["Tokyo", "Asia"], ["country"], [("noun", "an island country in Asia [-] [translation]: 日本")]), _entry("japan", ".0000001", ["漆"], ["lacquer"], [], [("noun", "a black lacquer [-] [translation]: 漆, 漆器")])]),
    ("contraction", [_entry("contraction", ".000004", ["収縮", "引き締め"], ["shrinking"], ["muscle"], [("noun", "the act of becoming smaller [-] [translation]: 収縮")])]),
    ("squeeze", [_entry("squeeze", ".000006", ["絞る", "引き締め", "締め付け"], ["press"], ["lemon"], [])]),
    ("physician", [_entry("physician", ".000009", ["医者", "内科医"], ["doctor"], ["patient"], [])]),
    ("shore", [_entry("shore", ".00001", ["岸", "川岸"], ["coast"], ["sea"], [])]),
    ("drumstick", [_entry("drumstick", "0", [], [], [], [("noun", "a stick for playing a drum [-] [translation]: ばち, もも肉 [-] [note]: plural")])]),
    ("muse", [_entry("muse", "", ["ミューズ"], [f"r{i}" for i in range(20)], [f"c{i}" for i in range(24)], [])]),
    ("mouse", [_entry("mouse", ".00002", ["ネズミ", "マウス"], ["rat"], ["computer"], [("noun", "a small rodent [-] [translation]: ネズミ"), ("noun", "a device of a computer for software [-] [translation]: マウス")])]),
]
INFLECTIONS = [("ran", ["run"]), ("mice", ["mouse"]), ("tightened", ["tighten"]), ("banks", ["bankx", "bank"]), ("running", ["run"])]
WORDS = ["run", "Run", "ran", "mice", "bank", "banks", "japan", "xyzzy", "tightening", "  Policy  "]
CONTEXTS = [
    (1, "bank", "He walked along the river to the shore."),
    (2, "bank", "The loan and the money are with the doctor."),
    (3, "tightening", "The Fed's policy and money growth; monetary policy."),
    (4, "tightening", ""),
    (5, "xyzzy", "Any river."),
    (6, "mice", "The server and its client software ran."),
    (7, "japan", "A country with a river."),
    (8, "muse", "bank bank river tightening contraction squeeze physician shore drumstick mouse doctor server policy japan money run tighten"),
]
TEXTS = [
    (1, "The Fed's tightening policy. Money and banks ran dry!"),
    (2, "The doctor at the clinic sees a patient in the hospital."),
    (3, "金融引き締め政策。川は広い！"),
    (4, ""),
    (5, "hello there friend"),
    (6, "12 34 5.6"),
    (7, "ＡＢ 日本語 with café 'n' rock’n’roll x2 2x -dash"),
    (8, None),
    (9, "The bank and the market; inflation, tax and trade. Shore? River\nMice."),
]
#: id, set, headword, task, output, label under j1 and j2.
PROBES = [
    (1, "s", "alpha", "P1", "アルファ", "K", "K"), (2, "s", "beta", "P1", "beta", "U", "U"), (3, "s", "gamma", "P1", "がんま", "X", "P"), (4, "s", "delta", "W1", None, None, None),
    (5, "s", "bank", "P1", "銀行", "K", "K"), (6, "s", "tightening", "P1", "金融引き締め", "P", "P"), (7, "s", "doctor", "W1", "内科医", "X", "X"), (8, "s", "river", "P1", "川。", "K", "K"),
    (9, "s", "money", "W1", "とても長い答えなのでこれは翻訳ではなく説明になってしまう", "U", "U"), (10, "s", "run", "P1", "歩く", "X", "X"), (11, "s", "policy", "W1", "方針", "K", "K"), (12, "s", "squeeze", "P1", "収縮した", "X", "P"),
]
#: headword, layer, quantile, log frequency.
SAMPLES = [("alpha", "main", 0, -2.123), ("beta", "main", 0, -2.9), ("gamma", "main", 1, -3.456), ("delta", "main", 1, -3.5), ("bank", "main", 1, -4.0), ("bank", "multi_sense", None, -4.0), ("tightening", "main", 2, -4.733), ("doctor", "main", 2, -4.1), ("river", "domain", None, -4.2), ("money", "main", 3, -3.8), ("run", "main", 3, -3.4), ("policy", "main", 4, -4.2), ("squeeze", "main", 4, -5.2)]
AUDITS = [(1, 1, "done", "accept"), (2, 3, "done", "reject"), (3, 6, "done", "accept"), (4, 7, "done", "accept"), (5, 10, "done", "unknown"), (6, 12, "pending", None), (7, 2, "done", "reject"), (8, 5, "done", "accept")]
ANSWERS = [(1, "議会", ["議会", "国会"]), (2, "議会。", ["議会"]), (3, "引き締め", ["金融引き締め"]), (4, "締", ["締め付け"]), (5, "全く別語", ["議会"]), (6, "parliament", ["議会"]), (7, None, ["議会"]), (8, "", ["議会"]), (9, "インター・チェンジ", ["いんたあちぇんじ", "インターチェンジ"]), (10, "これは三十六文字の長い説明文であり、単語の翻訳ではないため判定できない。", ["議会"]), (11, "議会の建物はとても大きくて広い所", ["議会"])]
SENTENCES = [(1, "tightening", "Monetary tightening hurts; tightening again."), (2, "tightening", "Tightening is here."), (3, "tighten", "They tightened it."), (4, "rate", "No such word."), (5, "a.b", "An a.b and axb."), (6, "run", "He runs; rerun.")]
VERDICTS = ["はい", "はい。", "Yes, it is", "いいえ", "No", "not sure", "たぶん", "", None, "答えははい", "rejected", "ACCEPT"]


def literal(v) -> str:
    """A value as SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(literal, v)) + "]" + ("" if v else "::VARCHAR[]")
    return "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


def raw_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, json.dumps(e, ensure_ascii=False)) for i, (k, e) in enumerate(LEXICON)], "key string, freq_rank long, raw string")


def inflections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INFLECTIONS, "form string, lemmas array<string>")


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, h, "m", t, f"{t.lower()}_v1.txt@pr1", o) for i, s, h, t, o, _, _ in PROBES], "id long, set_id string, headword string, model_id string, task string, prompt_ver string, raw_output string")


JUDGMENTS = [(p[0], label, "r", "", version) for p in PROBES for version, label in (("j1", p[5]), ("j2", p[6])) if label]
TASKS = [(i, p, s, None if v is None else json.dumps({"verdict": v})) for i, p, s, v in AUDITS]


def judgments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(JUDGMENTS, "probe_id long, label string, rule string, matched string, judge_ver string")


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s", h, layer, q, f, None) for h, layer, q, f in SAMPLES], "set_id string, headword string, layer string, quantile int, log_freq double, domain string")


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, "id long, probe_id long, status string, result string")
