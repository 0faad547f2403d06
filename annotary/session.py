"""Session helpers: settings, shared scratch folder, null-safe joins, sized frames."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name="annotary", master=None, conf=None):
    """A session with the settings the library is written for.

    Time zone is pinned so that naive device clocks never jump, adaptive
    execution is on so that skewed joins split at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The shared folder for checkpoints and scratch tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session,
    whose driver and tasks share one disk, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="annotary-")
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return (configured or current).rstrip("/")


def _scratch_root(spark):
    return f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}"


def scratch_path(spark, name):
    """A fresh path in this application's part of the shared folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark):
    """Delete this application's scratch tables, once nothing reads them any more."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def pinned(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so later reads see exactly the same rows.

    Needed wherever a second job depends on how the first one laid rows out
    (range partitions, generated ids); a lost executor cannot change them.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def evaluate_once(df: DataFrame, **columns) -> DataFrame:
    """Add expensive columns that later filters and joins must not repeat.

    A filter on a plain computed column is pushed below it and carries a copy
    of the whole expression along. Columns that come out of a generator stay
    where they are.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


@contextmanager
def settings(spark, **values):
    """Session settings for what runs inside; underscores stand for dots."""
    before = {key.replace("_", "."): spark.conf.get(key.replace("_", "."), None) for key in values}
    for key, value in values.items():
        spark.conf.set(key.replace("_", "."), value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles_freed(spark):
    """The shuffle files of what is written inside are deleted with its end, not with the driver's garbage."""
    return settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true")


def sized(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table whose size in bytes the planner knows.

    So Spark itself chooses between a broadcast and a shuffle, by its
    threshold in bytes, and nothing passes through the driver unasked.
    """
    path = scratch_path(df.sparkSession, "sized")
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_null_safe(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Equi-join on ``keys`` in which null meets null; the left keys are kept."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(named, on, how).drop(*[f"_r_{key}" for key in keys])
