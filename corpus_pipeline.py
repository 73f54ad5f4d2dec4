"""A training corpus from ``documents``: language, exact and near copies, source weights, tokens.

Every stage takes (spark, docs, folder) and returns a frame; it is written as Parquet to the shared folder and read
again as the next one's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undercroft.llm import bpe, exact, language, mixing, simhash
from undercroft.llm.common import staged, table
from undercroft.llm.queries import vocabulary


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a letter, or of no language with a probability of one half, go."""
    return language.known_language(docs, least=0.5)


def without_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of texts that are equal but for white space, the smallest id stays."""
    return exact.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of texts linked by SimHash (four-word shingles, four bits, as operator 8's contract has it), the smallest id stays."""
    return simhash.drop_near_copies(docs, size=4)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources by weight; a document stands as often as the mix takes it, at most twice."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), budget=1.5, most_repeats=2)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each document, with the digests of operator 4."""
    return bpe.encode_documents(docs, vocabulary(), with_ids=True)


STAGES = [
    ("language", known_language),
    ("exact", without_copies),
    ("near", without_near_copies),
    ("mix", mixed),
    ("encode", encoded),
]

#: Naive Bayes, SimHash components and BPE have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), f"stage-{name}")
    return STAGES[-1][1](spark, docs, folder)
