"""Registered queries of the operators; each is thin over its operator."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft.llm import bpe, contamination, exact, language, mixing, negatives, neighbours, passages, privacy, simhash, suffixes, trie, urls
from undercroft.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file; ``TOKENIZERS`` may name another folder."""
    return os.path.join(os.environ.get("TOKENIZERS", "/opt/tokenizers"), name)


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), weights=(3, 1, 2), budget=1.5, most_repeats=2)


def op2_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.drop_passages(table(spark, folder, "documents"), runs=passages.WORDS)


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "n_class")
    return privacy.find_private(table(spark, folder, "documents")).select(*columns)


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"), vocabulary())


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_id(table(spark, folder, "documents"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.filter_urls(table(spark, folder, "pages").select("page_id", "url"), rules=urls.FIXED).select("page_id", "host", "path", "rule", "verdict")


def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), every=50, k=5)


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_dedup(table(spark, folder, "documents"), size=4)


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_dedup(table(spark, folder, "documents"))


def op10_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, folder, "documents"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), label_col=moved)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = trie.ordered_turns(table(spark, folder, "conversations"))
    return trie.node_digests(trie.prefix_trie(trie.branches(turns)))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = contamination.words_covered()
    names = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mix_sources, op2_passages, op3_personal_data, op4_bpe, op5_language_id, op6_url_filter, op7_nearest, op8_simhash, op9_exact_dedup, op10_repeated_bytes, op11_hard_negatives, op12_prefix_trie, op13_decontamination, pipeline)}
ORACLE_SQL: dict[str, str] = {"op1_mix_sources": mixing.MIX_SQL, "op6_url_filter": urls.URL_SQL, "op9_exact_dedup": exact.COPIES_SQL, "op11_hard_negatives": negatives.NEGATIVES_SQL, "op12_prefix_trie": trie.TRIE_SQL, "op13_decontamination": contamination.CONTAMINATION_SQL}
