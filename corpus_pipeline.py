"""A training corpus from the documents table: five operators, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.llm import common, crf, decontam, exact, jaccard, mixing

#: The field and the rounding are no SQL; tests/llm holds each stage, and run(), against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject; null, empty and blank texts go. Repeated rows are judged alike."""
    return crf.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of least doc_id; rows of null text all stay."""
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each group of near duplicates. Rows of null doc_id, and of texts without a word, stay."""
    name = common.unused(docs, "_drop")
    drop = jaccard.near_duplicate_ids(docs).select(F.col("doc_id").alias(name))
    return common.join_checked(docs, drop, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; rows of null doc_id or text stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of copies that the target weights of their sources ask for; rows of null doc_id go, a null source is the source ''."""
    return mixing.mixed(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("benchmark_free", benchmark_free), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
