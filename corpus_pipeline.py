"""A corpus from raw documents: toxic ones out, one of each group of near copies, repeated passages out, sources mixed, sequences packed.

Any column may be null and any table empty: such rows score, match and count as empty texts, and an empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import jaccard, mixing, packing, substrings, toxicity
from lexloom.llm.common import read, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score less than 0.5; examples are the labelled rows among docs."""
    return toxicity.clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity 0.8 or more. Rows without words stay."""
    return jaccard.deduplicated(docs)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the words of 50-word windows that a smaller doc_id has too."""
    return substrings.without_repeats(docs)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a document, with its ids and its place in a sequence of at most 1,024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("n-gram Jaccard join", near_copies_out),
    ("substring dedup", passages_out),
    ("mixing sources to target weights", sources_mixed),
    ("packing", packed),
]

#: Neither a fitted classifier nor a tokenizer can be put in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents table; every stage is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
