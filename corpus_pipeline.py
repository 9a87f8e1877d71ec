"""A training-corpus pipeline: five stages over ``documents``, each one operator of loomgraph.llm.

Stages work on all that their predecessor kept, and their decisions take effect: toxic documents go, documents that the quality rules
reject go, one document of each near-duplicate group stays, a document that the mix takes twice appears twice and one that it does not
take goes, and what remains is encoded.

Edge cases, in every stage: each row is judged by its own content, so that rows with a null doc_id, or with one that other texts share,
are kept or rejected one by one; rows that are equal in all columns are copies of each other, of which near_duplicates keeps one; a
null or empty text scores as one without windows, fails the quality rules (fewer than 20 words), and would stay in near_duplicates and
not be taken by the mix; texts of any length are worked on whole; columns beyond those of documents are left aside at the start; a
table without rows passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, host_rules, mixing, partenum, toxicity
from loomgraph.llm.common import materialize
from loomgraph.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.ordinary_rows(docs.select(COLUMNS), labels)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.kept_rows(docs.select(COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return partenum.one_of_each_group(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs.select(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path(), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: compression, PartEnum and BPE have no SQL form; tests/llm compares the stages with brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
