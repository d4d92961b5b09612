"""Queries on words, sentences, languages, terms and domains of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import terms
from ..sources.tables import read
from . import fixtures as V

#: Words that a corpus has too rarely to be given a probability.
FLOOR = 3e-6


def both(spark, sf_dir):
    """documents and the fixture texts, which are in other scripts; their ids are negative."""
    more = spark.createDataFrame([(-i, t) for i, t in V.TEXTS], "doc_id long, text string")
    return read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(more)


# SQL twins of the text functions

SPACE = T.SPACE


def words_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(coalesce({x}, ''), '{T.WORD['re2'].replace(chr(39), chr(39) * 2)}'), lambda w: regexp_matches(w, '{T.LATIN['re2']}'))"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def norm_sql(x: str) -> str:
    return strip_sql(f"regexp_replace(regexp_replace(translate(lower({x}), '{T._MARKED}', '{T._PLAIN}'), '[・·\\x{{0300}}-\\x{{036F}}]+', '', 'g'), '{SPACE}+', ' ', 'g')")


def stop_sql(x: str) -> str:
    return f"({x} = '' OR lower({x}) IN ({', '.join(V.literal(w) for w in T.STOP_WORDS)}) OR regexp_matches({x}, '{T.NUMERIC}'))"


def content_sql(x: str) -> str:
    return f"(length({x}) >= 2 AND NOT {stop_sql(x)})"


def sentences_sql(x: str) -> str:
    parts = f"string_split(regexp_replace(coalesce({x}, ''), '({T.SENTENCE_END})', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {strip_sql('s')}), lambda s: s <> '')"


BOTH = V.values("v", "doc_id, text", [(-i, t) for i, t in V.TEXTS]) + ", d AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM v)"


def tok_sql(table: str, key: str = "doc_id", text: str = "text") -> str:
    return f"tok AS (SELECT id, surface, pos, {norm_sql('surface')} AS word FROM (SELECT id, unnest(w) AS surface, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT {key} AS id, {words_sql(text)} AS w FROM {table})))"


LEX = f"lex AS (SELECT word, n, CASE WHEN n / total >= {FLOOR} THEN n / total ELSE 0 END AS probability FROM (SELECT word, n, sum(n) OVER () AS total FROM (SELECT {norm_sql('surface')} AS word, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS surface FROM documents) GROUP BY 1) WHERE word <> ''))"


def f01(spark, sf):
    return terms.located_tokens(both(spark, sf)).withColumnRenamed("id", "doc_id")


# offsets: each run is sought from the end of the one before
F01 = f"""WITH {BOTH}, runs AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{T.WORD['re2'].replace("'", "''")}') AS r FROM d),
 u AS (SELECT doc_id, text, unnest(r) AS surface, generate_subscripts(r, 1) AS k FROM runs),
 gaps AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{T.WORD['re2'].replace("'", "''")}') AS g FROM d),
 g AS (SELECT doc_id, unnest(g) AS gap, generate_subscripts(g, 1) AS k FROM gaps),
 o AS (SELECT u.doc_id, u.surface, u.k, sum(length(g.gap)) OVER (PARTITION BY u.doc_id ORDER BY u.k) + sum(length(u.surface)) OVER (PARTITION BY u.doc_id ORDER BY u.k) - length(u.surface) AS place FROM u JOIN g USING (doc_id, k))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, surface, place AS "offset" FROM o WHERE regexp_matches(surface, '{T.LATIN['re2']}')"""


def f02(spark, sf):
    more = spark.createDataFrame([(-i, 0, t) for i, t in V.TEXTS], "conv_id long, turn long, text string")
    talks = read(spark, sf, "conversations").select("conv_id", "turn", "text").unionByName(more)
    return talks.select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("nth", "sentence")).withColumn("chars", F.char_length("sentence"))


F02 = f"""WITH {V.values('v', 'conv_id, turn, text', [(-i, 0, t) for i, t in V.TEXTS])}, c AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM v),
 s AS (SELECT conv_id, turn, {sentences_sql('text')} AS s FROM c)
SELECT conv_id, turn, generate_subscripts(s, 1) - 1 AS nth, unnest(s) AS sentence, length(unnest(s)) AS chars FROM s"""


def f03(spark, sf):
    latin, letters = T.english_parts(F.col("text"))
    return both(spark, sf).select("doc_id", T.language(F.col("text")).alias("language"), latin.alias("latin"), letters.alias("letters"), T.is_english_heavy(F.col("text")).alias("english_heavy"), T.has_japanese(F.col("text")).alias("has_japanese"))


def _n(p: str) -> str:
    return f"coalesce(len(regexp_extract_all(text, '{p}')), 0)"


F03 = f"""WITH {BOTH}, n AS (SELECT doc_id, text, {_n(T.KANA)} + {_n(T.HAN['re2'])} AS ja, {_n(T.LATIN['re2'])} AS la, {_n('[' + T.LATIN['re2'] + chr(92) + 'p{N}]')} AS latin, {_n('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} AS letters FROM d),
 l AS (SELECT *, CASE WHEN ja > la THEN 'ja' WHEN la > 0 THEN 'en' ELSE 'other' END AS language FROM n)
SELECT doc_id, language, latin, letters, language = 'en' OR (letters > 0 AND latin / letters > {T.ENGLISH_ENOUGH}) AS english_heavy, coalesce(regexp_matches(text, '{T.JAPANESE}'), false) AS has_japanese FROM l"""


def c15(spark, sf):
    t = terms.tokens(both(spark, sf))
    return t.groupBy("id").agg(F.count("*").alias("tokens"), F.count_if(T.is_stop_word(F.col("word"))).alias("stop_words"), F.count_if(T.is_content(F.col("word"))).alias("content"), F.count_if(T.is_numeric(F.col("word"))).alias("numeric"))


C15 = f"WITH {BOTH}, {tok_sql('d')} SELECT id, count(*) AS tokens, count(*) FILTER ({stop_sql('word')}) AS stop_words, count(*) FILTER ({content_sql('word')}) AS content, count(*) FILTER (regexp_matches(word, '{T.NUMERIC}')) AS numeric FROM tok GROUP BY id"


def e01(spark, sf):
    return terms.context_tf(read(spark, sf, "benchmark"), terms.corpus_lexicon(read(spark, sf, "documents")), "item_id")


E01 = f"WITH {LEX}, {tok_sql('benchmark', 'item_id')} SELECT id, word, count(*) AS tf, min(pos) AS first_pos FROM tok WHERE {content_sql('word')} AND word IN (SELECT word FROM lex) GROUP BY ALL"


def e04(spark, sf):
    return terms.unknown_words(read(spark, sf, "benchmark"), terms.corpus_lexicon(read(spark, sf, "documents")), "item_id")


E04 = f"WITH {LEX}, {tok_sql('benchmark', 'item_id')} SELECT id, count(*) FILTER (word NOT IN (SELECT word FROM lex)) AS unknown, count(*) AS words FROM (SELECT DISTINCT id, word FROM tok WHERE word <> '') GROUP BY id"


def e05(spark, sf):
    hits = terms.domain_hits(both(spark, sf)).withColumnRenamed("id", "doc_id")
    return hits.withColumn("domains", F.concat_ws(",", terms.domains()))


def _e05() -> str:
    hit = {n: f"len(list_filter(c, lambda w: w IN ({', '.join(V.literal(x) for x in dict.fromkeys(ws.split()))})))" for n, ws in S.DOMAINS.items()}
    listed = ", ".join(f"CASE WHEN words > 0 AND {n} / words >= {terms.DOMAIN_SHARE} THEN '{n}' END" for n in S.DOMAINS)
    return f"""WITH {BOTH}, c AS (SELECT doc_id, list_filter(list_transform({words_sql('text')}, lambda w: {norm_sql('w')}), lambda w: {content_sql('w')}) AS c FROM d),
 h AS (SELECT doc_id, len(c) AS words, {', '.join(f'{x} AS {n}' for n, x in hit.items())} FROM c)
SELECT *, concat_ws(',', {listed}) AS domains FROM h"""


def q05(spark, sf):
    docs = read(spark, sf, "documents")
    return terms.extract_terms(docs, terms.corpus_lexicon(docs, FLOOR)).withColumn("score", F.round("score", 6))


def _terms_sql(n: int = 20) -> str:
    return f"""cnt AS (SELECT id, word, count(*) AS tf, min(pos) AS first_pos, bool_or(pos > 0 AND regexp_matches(surface, '^\\p{{Lu}}')) AS proper FROM tok WHERE {content_sql('word')} GROUP BY id, word),
 sc AS (SELECT id, word, first_pos, tf / sum(tf) OVER (PARTITION BY id) * CASE WHEN proper THEN 1.5 ELSE 1.0 END AS weight FROM cnt),
 rk AS (SELECT id, word, first_pos, weight * greatest(0.0, least(1.0, (log10(probability) + 7.0) / 2.0)) AS score FROM sc JOIN lex USING (word) WHERE probability > 0),
 top AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, first_pos) AS nth, word, score, first_pos FROM rk QUALIFY nth <= {n})"""


Q05 = f"WITH {LEX}, {tok_sql('documents')}, {_terms_sql()} SELECT id, nth, word, round(score, 6) AS score, first_pos FROM top"


def q06(spark, sf):
    talks = read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    return terms.document_terms(talks, terms.corpus_lexicon(read(spark, sf, "documents"), FLOOR), 20, "k").select("id.conv_id", "id.turn", "nth", "word")


Q06 = f"""WITH {LEX}, sen AS (SELECT conv_id, turn, generate_subscripts(s, 1) AS sn, unnest(s) AS sentence FROM (SELECT conv_id, turn, {sentences_sql('text')} AS s FROM conversations)),
 {tok_sql('sen', "struct_pack(c := conv_id, t := turn, s := sn)", 'sentence')}, {_terms_sql()},
 f AS (SELECT id.c AS conv_id, id.t AS turn, word, min(id.s * 1000 + nth) AS first FROM top GROUP BY ALL)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY first) AS nth, word FROM f QUALIFY nth <= 20"""


def c20(spark, sf):
    return terms.should_fire(both(spark, sf), terms.corpus_lexicon(read(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")))


C20 = _e05().replace("SELECT *, concat_ws", "SELECT doc_id, concat_ws", 1)
C20 = f"""WITH lex AS (SELECT DISTINCT {norm_sql('surface')} AS word FROM (SELECT unnest({words_sql('text')}) AS surface FROM benchmark)),
 l AS ({F03}), dom AS ({C20}), b AS (WITH {BOTH} SELECT * FROM d), {tok_sql('b')},
 un AS (SELECT id, count(*) FILTER (word NOT IN (SELECT word FROM lex)) / count(*) AS share FROM (SELECT DISTINCT id, word FROM tok WHERE word <> '') GROUP BY id)
SELECT l.doc_id AS id, l.english_heavy AND (coalesce(un.share, 0) > {terms.UNKNOWN_SHARE} OR dom.domains <> '') AS fires FROM l JOIN dom USING (doc_id) LEFT JOIN un ON un.id = l.doc_id"""

QUERIES = {"f01_tokens": f01, "f02_sentences": f02, "f03_language": f03, "c15_stopword_share": c15, "c20_should_fire": c20, "e01_context_tf": e01, "e04_unknown_ratio": e04, "e05_domains": e05, "q05_extract_terms": q05, "q06_document_terms": q06}
ORACLE_SQL = {"f01_tokens": F01, "f02_sentences": F02, "f03_language": F03, "c15_stopword_share": C15, "c20_should_fire": C20, "e01_context_tf": E01, "e04_unknown_ratio": E04, "e05_domains": _e05(), "q05_extract_terms": Q05, "q06_document_terms": Q06}
