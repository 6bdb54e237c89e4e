"""Session defaults and the shared folder that written stages use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def local_session(cores: str = "8", app: str = "demandspark") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        .getOrCreate()
    )


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of a few MB, unless the session names a size itself.

    Spark's own limit of 64 MB is held by the executor and by the worker, each more than once.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def stage_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session (tests, bench) may do without: it gets a temporary one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="demandspark-"))
    return sc.getCheckpointDir()


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows over all shuffle partitions ahead of work that is heavy per row.

    The rows are few bytes each, so adaptive execution would merge them into
    few tasks. An explicit number of partitions keeps it from that, and
    hashing the keys once more keeps the shuffle from being dropped as
    redundant.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(*keys))


def stage(df: DataFrame) -> DataFrame:
    """Write a result once that several later steps read.

    The rows go to a table in the shared folder, so a lost executor costs a
    re-read and not a re-run, every later branch sees the same rows, and the
    readers still prune columns, push filters down and know the size.
    """
    path = new_stage_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
