"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows in memory to bytes of their file: over 10 for postings and line items.
ROWS_TO_FILE = 20.0


def local_session(cores: str = "8", app: str = "vellum") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("VELLUM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def sized(spark: SparkSession) -> SparkSession:
    """Let the planner take scans for as large as their rows are, not as their compressed files.

    Otherwise postings and other tables of few distinct values look small enough to be broadcast.
    A factor that the session has already is kept.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name, "1.0")) == 1.0:
        spark.conf.set(name, str(ROWS_TO_FILE))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables, named in ``spark.checkpoint.dir``.

    A temporary folder stands in for it only under a local master, as in tests.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written once in the shared folder: later plans start from a scan of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
