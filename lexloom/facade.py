"""One object for a lexicon: its tables, built once, and every question that is asked of them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import evaluation, lexicon, meanings, search, terms


class Lexicon:
    """raw: key, freq_rank, raw (a key's entries as JSON); inflections: form, lemmas.

    Every method declares a DataFrame and runs nothing; `words`, `texts` and the like are DataFrames too, so one word and a corpus are asked
    alike. The record tables are plans: cache or write them before many questions.
    """

    def __init__(self, raw: DataFrame, inflections: DataFrame):
        self.raw, self.inflections = raw, inflections

    @cached_property
    def records(self) -> DataFrame:
        return lexicon.entries(self.raw)

    @cached_property
    def scored(self) -> DataFrame:
        return meanings.scored_records(self.records)

    @cached_property
    def links(self) -> DataFrame:
        return lexicon.links(self.records)

    def contains(self, words: DataFrame) -> DataFrame:
        return lexicon.exists(words, self.records)

    def lookup(self, words: DataFrame) -> DataFrame:
        return lexicon.lookup(words, self.records, self.inflections)

    def lookup_raw(self, words: DataFrame) -> DataFrame:
        return lexicon.raw_json(words, self.raw)

    def reverse(self, glosses: DataFrame, capacity: int = 100) -> DataFrame:
        return lexicon.reverse(glosses, self.links, capacity)

    def synonyms(self, **limits: int) -> DataFrame:
        return lexicon.synonyms(self.links, **limits)

    def search(self, mode: str, pattern: str, capacity: int = 0) -> DataFrame:
        return search.search(self.raw.select("key", "freq_rank"), mode, pattern, capacity)

    def phrases(self, asked: DataFrame) -> DataFrame:
        return lexicon.phrases(asked, self.records)

    def resolve(self, asked: DataFrame, max_meanings: int = 8) -> DataFrame:
        return meanings.resolve(asked, self.scored, self.inflections, max_meanings)

    def enrich(self, texts: DataFrame, max_terms: int = 20, max_meanings: int = 8) -> DataFrame:
        return meanings.enrich(texts, self.scored, self.inflections, max_terms, max_meanings)

    def hints(self, texts: DataFrame, max_candidates: int = 8) -> DataFrame:
        return meanings.hints(self.enrich(texts), max_candidates)

    def extract(self, texts: DataFrame, max_terms: int = 20) -> DataFrame:
        """Terms of texts (id, text), weighed by what the lexicon knows of their words: the most probable entry of each key."""
        known = self.records.groupBy(F.col("key").alias("word")).agg(F.max("prob").alias("probability"))
        return terms.extract_terms(texts, known, max_terms, "id", "text")

    def answer(self, arguments: DataFrame) -> DataFrame:
        return meanings.tool_answer(arguments, self.scored, self.inflections)

    def compact(self, limit: int | None = None) -> DataFrame:
        return lexicon.compact(self.records, limit)

    def polysemous(self, **limits: int) -> DataFrame:
        return evaluation.polysemous(self.records, **limits)

    def stats(self) -> DataFrame:
        return evaluation.dictionary_stats(self.records)

    def domains(self) -> DataFrame:
        return self.scored.select("key", "entry_idx", "domain")
