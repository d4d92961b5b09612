"""Scores of entries and meanings in a context, as Columns. Sparse vectors are maps from word to weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Shares of the score, scales, and limits.
FREQUENCY_SHARE, DOMAIN_SHARE, CONTEXT_SHARE = 0.30, 0.30, 0.40
EVIDENCE, RELATED, COOCCURRENCE, DECAY = 24, 16, 20, 0.95
SENSE_CHARS, ORDER_DECAY, PRIOR_SHARE, SENSE_SHARE = 320, 0.94, 0.4, 0.6
DOMAIN_ITEMS, DOMAIN_CHARS, HEADWORD_POINTS, DOMAIN_POINTS = 12, 400, 3, 2
LABELS = {"economics": "経済", "medicine": "医療", "technology": "IT", "law": "法律", "science": "科学", "general": "一般"}
#: A small lexicon of our own; a full one is a parameter wherever domains are guessed.
DOMAINS = {
    "economics": "bank banking bond credit currency debt deflation economy finance financial inflation interest loan market monetary money policy price tax tightening trade",
    "medicine": "cancer clinic disease doctor dose drug health hospital medicine nurse patient surgery symptom therapy treatment vaccine virus",
    "technology": "algorithm client cloud compiler computer database hardware internet network processor programming server software technology",
    "law": "appeal attorney contract court crime evidence judge justice law lawyer legal parliament statute trial verdict",
    "science": "biology cell chemistry climate energy evolution experiment hypothesis laboratory molecule physics quantum research science theory",
}


def base_frequency(p: Column) -> Column:
    """F-17: the logarithm of a probability from 1e-7 to 1e-2 as 0 to 1; 0 for none."""
    return F.when(p > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log10(p) + 7.0) / 5.0))).otherwise(0.0)


def idf(p: Column) -> Column:
    """F-26: rises with the probability (a quirk that results depend on), 1 from 1e-5 up; null for a censored probability."""
    return F.when(p > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log10(p) + 7.0) / 2.0)))


def evidence(related: Column, cooccurrence: Column) -> Column:
    """The words whose presence in a context speaks for an entry."""
    both = F.concat(F.slice(cooccurrence, 1, EVIDENCE), F.slice(related, 1, EVIDENCE))
    return F.array_distinct(F.filter(F.transform(both, T.fast_normalized), lambda w: w != ""))


def domain_match(own: Column, context: Column) -> Column:
    """F-18, S-02: 0 without a common word, else 0.2 and 0.4 for each, at most 1."""
    n = F.size(F.array_intersect(own, context))
    return F.when(n > 0, F.least(F.lit(1.0), 0.4 * n + 0.2)).otherwise(0.0)


def entry_features(word: Column, related: Column, cooccurrence: Column) -> Column:
    """F-19: the headword at 1, then related and co-occurring words, each new one at 0.95 of the one before."""
    head = T.fast_normalized(F.coalesce(word, F.lit("")))
    rest = F.filter(F.transform(F.concat(F.slice(related, 1, RELATED), F.slice(cooccurrence, 1, COOCCURRENCE)), T.fast_normalized), lambda w: w != "")
    names = F.array_distinct(F.concat(F.when(head != "", F.array(head)).otherwise(F.expr("cast(array() as array<string>)")), rest))
    first = F.when(head != "", 0).otherwise(1)
    return F.map_from_arrays(names, F.transform(names, lambda w, i: F.pow(F.lit(DECAY), i + first)))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(vector), F.lit(0.0), lambda a, x: a + x * x))


def cosine(a: Column, b: Column) -> Column:
    """F-20, F-21: 0 to 1; 0 if either is empty."""
    product = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.try_element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
    return F.when(product > 0, F.least(F.lit(1.0), product / (norm(a) * norm(b)))).otherwise(0.0)


def dense_cosine(a: Column, b: Column) -> Column:
    """F-20 on arrays of one length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def entry_score(p: Column, own: Column, features: Column, context: Column) -> Column:
    """F-22."""
    return FREQUENCY_SHARE * base_frequency(p) + DOMAIN_SHARE * domain_match(own, F.map_keys(context)) + CONTEXT_SHARE * cosine(context, features)


def sense_vectors(items: Column) -> Column:
    """F-23: of each sense the first 320 characters and their distinct words of two letters and more; senses without any are left out."""
    heads = F.filter(F.transform(items, lambda i: F.substring(F.coalesce(i["text"], F.lit("")), 1, SENSE_CHARS)), lambda h: h != "")
    made = F.transform(heads, lambda h: F.struct(h.alias("head"), F.array_distinct(F.filter(F.transform(T.words(h), T.fast_normalized), lambda w: F.char_length(w) >= T.SHORTEST_TERM)).alias("words")))
    return F.filter(made, lambda s: F.size(s["words"]) > 0)


def sense_similarity(translation: Column, senses: Column, context: Column) -> Column:
    """F-24, J-20: of the senses that mention the translation the largest overlap with the context, by both lengths."""
    of = lambda s: F.aggregate(s["words"], F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(context, w), F.lit(0.0)))
    best = F.array_max(F.transform(F.filter(senses, lambda s: s["head"].contains(translation)), lambda s: F.least(F.lit(1.0), of(s) / (norm(context) * F.sqrt(F.size(s["words"]))))))
    return F.when(F.size(F.map_keys(context)) > 0, F.coalesce(best, F.lit(0.0))).otherwise(0.0)


def ranked_translations(translations: Column, senses: Column, context: Column, most: int) -> Column:
    """F-25, W-07: array of struct(ja, weight, pos) by weight, of equal ones in their own order."""
    first = F.slice(translations, 1, most)
    alike = F.transform(first, lambda t, i: F.struct(t.alias("ja"), i.alias("pos"), sense_similarity(t, senses, context).alias("sim")))
    top = F.array_max(F.transform(alike, lambda x: x["sim"]))
    weighed = F.transform(alike, lambda x: F.struct(x["ja"].alias("ja"), F.when(top > 0, PRIOR_SHARE * F.pow(F.lit(ORDER_DECAY), x["pos"]) + SENSE_SHARE * (x["sim"] / top)).otherwise(F.pow(F.lit(ORDER_DECAY), x["pos"])).alias("weight"), x["pos"].alias("pos")))
    return F.array_sort(weighed, lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).otherwise(a["pos"] - b["pos"]))


def domain_points(word: Column, items: Column, lexicon: str) -> Column:
    """3 for the headword and 1 for each word of the first senses that is in the lexicon (words separated by spaces)."""
    known = F.array(*[F.lit(w) for w in dict.fromkeys(lexicon.lower().split())])
    head = F.when(F.array_contains(known, T.fast_normalized(F.coalesce(word, F.lit("")))), HEADWORD_POINTS).otherwise(0)
    heads = F.transform(F.slice(items, 1, DOMAIN_ITEMS), lambda i: F.substring(F.coalesce(i["text"], F.lit("")), 1, DOMAIN_CHARS))
    return head + F.size(F.filter(F.flatten(F.transform(heads, T.words)), lambda w: F.array_contains(known, T.fast_normalized(w))))


def domain(word: Column, items: Column, lexicons: dict[str, str] = DOMAINS) -> Column:
    """E-06: the label of the domain with most points, of equal ones the last by name; the general one under 2 points."""
    scored = F.array(*[F.struct(domain_points(word, items, w).alias("points"), F.lit(name).alias("name")) for name, w in lexicons.items()])
    best = F.array_max(scored)
    label = F.create_map(*[F.lit(x) for name in lexicons for x in (name, LABELS.get(name, name))])
    return F.when(best["points"] >= DOMAIN_POINTS, F.element_at(label, best["name"])).otherwise(F.lit(LABELS["general"]))
