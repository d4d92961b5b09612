"""Words, sentences, languages and word classes of texts, as Columns.

Patterns are written so that Java's engine and RE2 read them alike but for the name of the Latin script; LATIN holds both names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and limits that results depend on.
LATIN = {"java": r"\p{IsLatin}", "re2": r"\p{Latin}"}
HAN = {"java": r"\p{IsHan}", "re2": r"\p{Han}"}
DIGIT = r"\p{Nd}"
#: A run that starts with a letter or digit; words() keeps those with a letter.
WORD = {k: rf"[{v}{DIGIT}][-_'’{v}{DIGIT}]*" for k, v in LATIN.items()}
SENTENCE_END = r"[。.!?！？\n]+"
KANA = r"[\x{3040}-\x{30FF}]"
JAPANESE = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{001C}-\x{001F}]"
NUMERIC = r"^[\p{Nd}.,-]+$"
#: The same characters as LATIN and WORD; ASCII comes first, which Java's engine tests without a look at its table of scripts.
_FAST_LATIN = rf"[a-zA-Z{LATIN['java']}]"
_FAST_WORD = rf"[a-zA-Z0-9{LATIN['java']}{DIGIT}][-_'’a-zA-Z0-9{LATIN['java']}{DIGIT}]*"
#: Above this share of Latin letters and digits a text is English enough to enrich.
ENGLISH_ENOUGH = 0.30
SHORTEST_TERM = 2

# English function words, in alphabetical order and then adverbs of discourse.
STOP_WORDS = tuple(
    """
    a about above after again against all am an and any are aren't as at be because been before being below between both
    but by can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had
    hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll
    i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other
    ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the
    their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under
    until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's
    whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
    also just now then thus however therefore moreover furthermore meanwhile nevertheless nonetheless
    """.split()
)


def words(text: Column) -> Column:
    """F-01 without offsets: the word tokens in order; null text: an empty array. One pass of the pattern."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_FAST_WORD})"), F.lit(1))
    return F.filter(runs, lambda t: t.rlike(_FAST_LATIN))


def strip(c: Column) -> Column:
    """Without white space at the ends, ideographic space included."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def sentences(text: Column) -> Column:
    """F-02: sentences with their terminators, stripped, none empty."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), f"({SENTENCE_END})", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda s: s != "")


def _characters(text: Column, kind: str) -> Column:
    """How many characters of a class are in the text; runs are taken out at once, which costs less than a match a character."""
    c = F.coalesce(text, F.lit(""))
    return (F.char_length(c) - F.char_length(F.regexp_replace(c, f"{kind}+", ""))).cast("long")


def language(text: Column) -> Column:
    """F-03: ja if kana and Han outnumber Latin letters, else en if there are any, else other."""
    japanese, latin = _characters(text, rf"[\x{{3040}}-\x{{30FF}}{HAN['java']}]"), _characters(text, _FAST_LATIN)
    return F.when(japanese > latin, "ja").when(latin > 0, "en").otherwise("other")


def english_parts(text: Column) -> tuple[Column, Column]:
    """F-04: Latin letters and numbers, and all letters and numbers."""
    return _characters(text, rf"[a-zA-Z0-9{LATIN['java']}\p{{N}}]"), _characters(text, r"[a-zA-Z0-9\p{L}\p{N}]")


def english_ratio(text: Column) -> Column:
    part, whole = english_parts(text)
    return F.when(whole > 0, part / whole).otherwise(0.0)


def is_english_heavy(text: Column) -> Column:
    """C-18 and C-19."""
    return (language(text) == "en") | (english_ratio(text) > ENGLISH_ENOUGH)


def has_japanese(c: Column) -> Column:
    """C-21."""
    return F.coalesce(c.rlike(JAPANESE), F.lit(False))


#: Latin letters with marks and the same without, for normalisation on the JVM; other marks are dropped as combining characters.
_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def normalized(c: Column) -> Column:
    """U8, F-05 (own definition): lower case, middle dots and Latin diacritics off, white space collapsed and stripped."""
    plain = F.translate(F.lower(c), _MARKED, _PLAIN)
    return strip(F.regexp_replace(F.regexp_replace(plain, r"[・·\x{0300}-\x{036F}]+", ""), f"{SPACE}+", " "))


def normalized_token(c: Column) -> Column:
    """normalized() of a word token in one pass: a token holds no blank, middle dot or combining mark, but lower case may make one of a dotted I."""
    return F.translate(F.lower(c), _MARKED + "\u0307", _PLAIN)


def fast_normalized(c: Column) -> Column:
    """F-06: lower case, middle dots off, white space collapsed and stripped; diacritics stay."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), "[・·]+", ""), f"{SPACE}+", " "))


def is_numeric(c: Column) -> Column:
    """C-16, U11."""
    return F.coalesce(c.rlike(NUMERIC), F.lit(False))


#: U10 (own definition): Japanese particles, auxiliaries, pronouns and formal nouns.
JAPANESE_STOP_WORDS = tuple("の に は を が と で も や へ か ね よ な から まで より だ です ます ない たい れる られる せる させる する いる ある なる こと もの ため よう これ それ あれ この その あの ここ そこ 私 僕 彼 彼女 誰 何".split())


def is_stop_word(c: Column, language: str = "en") -> Column:
    """C-15, U10: a function word of the language (en or ja) in any case, a number, or empty; of other languages numbers only."""
    words = {"en": STOP_WORDS, "ja": JAPANESE_STOP_WORDS}.get(language, ())
    return F.coalesce((c == "") | F.lower(c).isin(*words) | is_numeric(c), F.lit(True))


def is_content(c: Column) -> Column:
    """C-15 and C-17 on a normalised word."""
    return (F.char_length(c) >= SHORTEST_TERM) & ~is_stop_word(c)


# The tags that end a sense's list of translations.
SENSE_TAGS = ("-", "synonym", "antonym", "hypernym", "hyponym", "derivative", "synset", "example", "note", "usage", "etymology")


def sense_translations(c: Column) -> Column:
    """F-07: the comma-separated list after [translation]: up to the next bracketed tag or the end."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?s)\[translation\]:\s*(.*?)(?=\[(?:{'|'.join(SENSE_TAGS)})|$)", 1)
    return F.filter(F.transform(F.split(found, ","), strip), lambda x: x != "")


def probability(c: Column) -> Column:
    """F-09: a number in text; null and bad ones are 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))
