"""Corpus pipeline: the stages between raw documents and packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quayside.llm.common import prepare, stored, table
from quayside.llm.queries import tokenizer_file
from quayside.llm import packing, stages


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Host-level quality rules; rejected documents go."""
    prepare(spark)
    return stages.keep_by_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents that have no other line."""
    prepare(spark)
    return stages.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8; one document of each group stays."""
    prepare(spark)
    return stages.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    prepare(spark)
    return stages.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document, packed into sequences of 2048."""
    prepare(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]

#: Not expressible in SQL: tokenisation and set-similarity stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
