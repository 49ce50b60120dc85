"""Shared helpers: written tables in the cluster's shared folder, and bounded slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that one step inside a Python task works on; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, which cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """All words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have about ``most`` bytes, which bounds the memory of array work."""
    for batch in batches:
        column = batch.column(text)
        if len(column) == 0:
            continue
        size = 0
        start = 0
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths.tolist()):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Let Python tasks get at most so many rows at a time, where rows are wide; the setting before comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on give Python tasks at most so many rows at a time, which bounds what a batch of long texts takes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def replaced(df: DataFrame, added: list[str]) -> DataFrame:
    """Drop the columns that an operator is about to add, so that its own win over clashing ones."""
    low = {c.lower() for c in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def judged_rows(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """The rows that an operator's added columns speak for, with their own columns, whatever those are called."""
    own = docs.columns
    hidden = docs.toDF(*[c if c in ("doc_id", "text") else f"_own_{c}" for c in own])
    return operator(hidden).where(keep).select(*hidden.columns).toDF(*own)
