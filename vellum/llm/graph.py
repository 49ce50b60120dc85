"""Connected components as joins and aggregates; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge, the root being the smallest node of its component.

    Each round hangs the larger neighbours of a node on its smallest one, then
    every node on the smallest of its smaller neighbours, until all edges point
    at a root. A hub never becomes one row: its edges are grouped by partial
    minima and joined back. The rounds grow with the logarithm of the longest
    path.
    """
    pairs = table(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges"
    )
    last = None
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large step: neighbours above u hang on the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small step: u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u")
        small = (
            large.withColumnRenamed("hi", "u")
            .join(low, "u")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .union(low.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
            .distinct()
        )
        pairs = table(small, "edges")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    roots = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
