"""Mixing sources to target weights by nested hash thresholds, with DataFrame operations only.

Each row has a 60-bit hash. Per source, a histogram sums the words by the top
bits of the hash; the budget ends inside one bucket, and only that bucket is
split by the next bits, until a threshold of all 60 bits is known. A filter on
the threshold then selects the rows: nothing is sorted, and a budget that is
larger takes a superset of the rows of a smaller one.

Defined cases: a null or empty text has size 0 and is never taken; a null source
is a source of its own, the last one; rows that agree in id and text share one
fate; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import table

HASH_BITS = 60
LEVEL_BITS = 12


def row_hash(doc_id: str, text: str) -> Column:
    """60 bits of the MD5 of id and text, the same in every run and engine."""
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Id, source, number of words and hash of each row."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"),
        row_hash(doc_id, text).alias("hash"),
    )


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, total: int | None = None) -> DataFrame:
    """One row per source: ``source_size`` and ``target`` words.

    Weights repeat along the sources by code point, null last. A target above
    ``most`` times its source stops there and the rest is shared by weight:
    sources are taken by rising limit per weight, and the first that can hold
    its share ends the list of the limited ones. There is one row per source
    here, so the windows are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table_of_weights = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per.withColumn("_w", F.get(table_of_weights, F.pmod(place, F.lit(len(weights))))).withColumn(
        "_cap", (F.lit(most) * F.col("source_size")).cast("double")
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    want = F.lit(float(total)) if total is not None else F.sum("source_size").over(everything).cast("double")
    marked = (
        weighed.withColumn("_want", want)
        .withColumn("_before", F.coalesce(F.sum("_cap").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_from", F.sum("_w").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_full", F.col("_cap") * F.col("_from") <= (F.col("_want") - F.col("_before")) * F.col("_w"))
    )
    share = (F.col("_want") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(everything), F.lit(0.0))) / F.sum(
        F.when(~F.col("_full"), F.col("_w"))
    ).over(everything)
    return marked.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(share * F.col("_w"))).select(
        "source", "source_size", "target"
    )


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole ``copies`` of every row, and the hash up to which rows get one copy more."""
    state = targets.select(
        F.col("source").alias("_s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint").alias("copies"),
        F.lit(0).cast("bigint").alias("_path"),
    ).withColumn("_left", F.col("target") - F.col("copies") * F.col("source_size"))
    kept = ["_s", "source_size", "target", "copies", "_left", "_path"]
    for level in range(HASH_BITS // LEVEL_BITS):
        low = HASH_BITS - LEVEL_BITS * (level + 1)
        inside = F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", low + LEVEL_BITS) == F.col("_path"))
        sums = (
            sizes.where("size > 0")
            .join(state, inside)
            .groupBy(*kept, F.shiftright("hash", low).alias("_bucket"))
            .agg(F.sum("size").alias("_sum"))
        )
        up_to = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        state = (
            sums.withColumn("_before", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)))
            .where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_sum")))
            .withColumn("_left", F.col("_left") - F.col("_before"))
            .select(*[c for c in kept if c != "_path"], F.col("_bucket").alias("_path"), "_sum")
        )
        if low:
            state = state.drop("_sum")
    return state.select(
        "_s",
        "source_size",
        "target",
        "copies",
        # the row at the border is taken if that comes nearer to the target
        F.when(2 * F.col("_left") >= F.col("_sum"), F.col("_path")).otherwise(F.col("_path") - 1).alias("threshold"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    most: int = 3,
    total: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Per row: ``doc_id, size, source_size, target, taken``, and ``copies`` of the row in the mix.

    ``total`` words are shared (the words of all rows, if none is given).
    """
    sizes = table(sized(docs, doc_id, text, source), "mix-sizes")
    targets = source_targets(sizes, weights, most, total)
    limits = thresholds(sizes, targets).select("_s", "copies", "threshold")
    plan = targets.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        # with every row taken `most` times there is no border
        F.coalesce("copies", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size"))).otherwise(0)).cast("bigint").alias("_whole"),
        F.coalesce("threshold", F.lit(-1)).alias("_threshold"),
    )
    copies = F.col("_whole") + (F.col("hash") <= F.col("_threshold")).cast("bigint")
    return (
        sizes.join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select("doc_id", "source", "hash", "size", "source_size", "target", "taken", "copies")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns only."""
    chosen = mix(docs, **options).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "copies"
    ).distinct()
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == row_hash("doc_id", "text"))
    return (
        docs.join(chosen.withColumnRenamed("copies", "_copies"), same)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .select(*docs.columns)
    )


