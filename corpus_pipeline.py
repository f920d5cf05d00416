"""The corpus pipeline: five stages over the documents table, each on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flightspark.llm import decontaminate, probminhash, quality_rules, sentencepieces, substring
from flightspark.session import checkpointed

# Byte-pair merges, edit budgets and min-wise signatures cannot be said in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.reject(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return probminhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words that a kept document with a smaller id has are cut out."""
    return substring.dedup_text(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left, and a digest of what they decode to."""
    return sentencepieces.encode(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("sentencepieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each keeps is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
