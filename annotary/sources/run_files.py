"""Run directories: ``<root>/<campaign>/<run>/{config,summary}.json`` and
``history.jsonl``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary import schemas
from annotary.operators.runs import join_runs


def named_by_folder(df: DataFrame) -> DataFrame:
    """Campaign and run from the last two directories of the file's path."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return df.select(
        F.regexp_extract(path, r"([^/]+)/([^/]+)/[^/]+$", 1).alias("campaign"),
        F.regexp_extract(path, r"([^/]+)/([^/]+)/[^/]+$", 2).alias("run"),
        "*",
    )


def run_summaries(spark: SparkSession, root) -> DataFrame:
    return named_by_folder(
        spark.read.schema(schemas.RUN_SUMMARY).json(f"{root}/*/*/summary.json", multiLine=True)
    )


def run_configs(spark: SparkSession, root) -> DataFrame:
    return named_by_folder(
        spark.read.schema(schemas.RUN_CONFIG).json(f"{root}/*/*/config.json", multiLine=True)
    )


def finished_runs(spark: SparkSession, root) -> DataFrame:
    """Runs with both files; one without summary is never a result."""
    return join_runs(run_summaries(spark, root), run_configs(spark, root))


def run_events(spark: SparkSession, path) -> DataFrame:
    """Event logs as JSON lines; a half-written last line is skipped."""
    return named_by_folder(
        spark.read.schema(schemas.RUN_EVENT).option("mode", "DROPMALFORMED").json(path)
    ).filter(F.col("type").isNotNull())
