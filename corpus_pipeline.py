"""A training corpus from raw documents: each stage reads what the one before it kept.

Quality classifier, toxicity, near-duplicate groups, mix of sources, packing. The
first four return documents with their own columns; the last returns the packed
pieces. Rows with null columns, empty texts and repeated rows pass through the
stages as the operators define; a stage of no rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import jaccard_join, mixing, packing, toxicity, weak_quality
from vellum.llm.common import bounded_batches, documents, judged_rows, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier takes for good."""
    bounded_batches(spark)
    return judged_rows(docs, weak_quality.classified, F.col("kept"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't take for toxic."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged_rows(docs, lambda d: toxicity.classified(d, labels), F.col("predicted") == 0)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    bounded_batches(spark)
    return jaccard_join.deduplicated(docs, width=5, num=80, den=100)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix of sources, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    bounded_batches(spark)
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", distinct_texts),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]
#: Trained models and a tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again for the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name.split()[0]}")
    return docs
