"""The registered queries of this subpackage and their SQL.

Each query applies its operator, with production parameters, to its whole table, and derives the contract's columns.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, context_mixing, host_rules, mixing, partenum, sharding, token_scan, toxicity, vptree
from .sql import ORACLES

SHARD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public vocabulary file; ``LOOMGRAPH_TOKENIZER`` names another."""
    if given := os.environ.get("LOOMGRAPH_TOKENIZER"):
        return given
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op5_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_fair_queue_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "key")


def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, sf_dir, "documents"))


def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.count_document_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge_documents(table(spark, sf_dir, "documents")).drop("host_rate", "host_low", "host_rejected")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_compression_toxicity, op2_context_mixing, op3_extendible_sharding, op4_fair_queue_mixing, op5_vantage_point_search, op6_partenum_join, op7_separator_scan, op8_host_rules, op9_bpe, op10_perspective_rotation)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
