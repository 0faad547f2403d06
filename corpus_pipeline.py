"""A training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; its table is written as Parquet and read again by the next. All stages
but the last return the columns of documents.
"""

from pyspark.sql import DataFrame

from annotary.llm import decontamination, language, mixing, near_dedup, secrets
from annotary.llm.shared import small_batches, written

LEAST_RATE = 0.01
ORACLE_SQL = None  # trained stages cannot be written in SQL; tests/llm compare each with a brute-force version


def known_languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told."""
    small_batches(spark)
    return language.known_language(docs, language.learn(docs))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def benchmark_free(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    small_batches(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_masked(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; every document stays."""
    return secrets.redact(docs)


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the rate, never below LEAST_RATE, at which it is to be drawn; drawing is left to the reader."""
    small_batches(spark)
    return mixing.soft_mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), floor=LEAST_RATE)


STAGES = [
    ("language_id", known_languages),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_free),
    ("secret_scan", secrets_masked),
    ("mixing", mixed),
]


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
