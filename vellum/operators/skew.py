"""Primitives that keep working when one key holds a large share of the rows.

A plain ``row_number() over (partition by key ...)`` sends a whole key to one
task. The helpers here either reduce before the shuffle (``top_k`` keeps k rows
per key and map task) or split a key into ranges of its order column and stitch
the ranges together with small prefix sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import written

RANGE_WIDTH = 1 << 20
#: Patterns that are sent to every text.
FEW_PATTERNS = 100_000


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark limits each key before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def number_within(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "seq", width: int = RANGE_WIDTH
) -> DataFrame:
    """1-based position of each row inside its key, by a unique whole-number column.

    Rows are split into ranges of ``width`` order values, so a task holds at most
    ``width`` rows of a key however many rows the key has.
    """
    return running_total(
        df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, "_one", out, width
    ).drop("_one")


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, width: int = RANGE_WIDTH
) -> DataFrame:
    """Inclusive running sum of ``value`` per key along a whole-number column."""
    keys = list(keys)
    ranged = df.withColumn("_range", F.floor(F.col(order) / width).cast("bigint"))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(value).over(inside))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return (
        local.join(offsets, same)
        .withColumn(out, F.col("_local") + F.col("_offset"))
        .select(*df.columns, out)
    )


def _pieces(low: Column, kind: int) -> Column:
    """What a text has that may hold a pattern: whole words between spaces (kind 0), or its runs of ``kind`` characters.

    The look-ahead lets the runs overlap, in one pass over the text.
    """
    if kind == 0:
        return F.transform(F.filter(F.split(low, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w))
    return F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{kind}}}))"), F.lit(1))


def _pattern_pieces(p: DataFrame, grams: int) -> DataFrame:
    """``pattern, kind, gram``: the words inside a pattern, or the runs of characters of one that has no space on either side of a word."""
    low = F.lower("pattern")
    parts = F.split(low, " ")
    inside = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != "")
    kind = F.when(F.size(inside) > 0, F.lit(0)).otherwise(F.least(F.length(low), F.lit(grams)))
    pieces = F.transform(inside, lambda w: F.concat(F.lit(" "), w))
    for n in range(1, grams + 1):
        pieces = F.when(kind == n, _pieces(low, n)).otherwise(pieces)
    return p.select("pattern", kind.alias("kind"), F.length(low).alias("n"), F.explode(F.array_distinct(pieces)).alias("gram"))


def containing(patterns: DataFrame, pattern: str, rows: DataFrame, text: str, grams: int = 3) -> DataFrame:
    """Each row of ``rows`` once for every distinct pattern that its text contains, any case, with the pattern in ``pattern``.

    Candidates come from an equi-join on the pattern's rarest piece and are then verified, so the result is exact without
    comparing every pattern with every text. The pieces of the texts are counted, then taken again, and not stored; few
    patterns are sent to the texts, many meet the names of distinct texts.
    """
    p = patterns.select(F.col(pattern).alias("pattern")).where(F.length("pattern") > 0).distinct()
    asked = written(_pattern_pieces(p, grams), "pieces")
    least = {r.kind: r.n for r in asked.groupBy("kind").agg(F.min("n").alias("n")).collect()}  # a row a kind
    low = F.lower(F.col(text))
    if not least:
        return rows.limit(0).withColumn("pattern", F.lit(""))
    taken = F.array_distinct(F.concat(*[_pieces(low, kind) for kind in sorted(least)]))
    long_enough = rows.where(F.length(low) >= min(least.values()))
    spread = (
        long_enough.select(F.explode(taken).alias("gram"))
        .join(asked.select("gram").distinct(), "gram", "left_semi")
        .groupBy("gram")
        .agg(F.count("*").alias("n_texts"))
    )
    # a pattern with a piece that no text has is in none
    known = asked.join(spread, "gram", "left").groupBy("pattern").agg(
        F.min_by("gram", F.struct(F.coalesce("n_texts", F.lit(0)), "gram")).alias("_gram"), F.min(F.coalesce("n_texts", F.lit(0))).alias("_n")
    )
    rarest = written(known.where("_n > 0").select("pattern", "_gram"), "rarest")
    found = F.instr(low, F.lower("pattern")) > 0
    if rarest.count() <= FEW_PATTERNS:
        return long_enough.withColumn("_gram", F.explode(taken)).join(F.broadcast(rarest), "_gram").where(found).select(*rows.columns, "pattern")
    named = rows.select(F.col(text)).where(F.col(text).isNotNull()).distinct().withColumn("_id", F.xxhash64(text))  # equal names only add candidates
    near = named.select("_id", F.explode(taken).alias("_gram")).join(rarest, "_gram").select("_id", "pattern").distinct()
    return rows.join(near.join(named, "_id").where(found).select(text, "pattern").distinct(), text).select(*rows.columns, "pattern")


def substring_pairs(
    patterns: DataFrame, pattern: str, texts: DataFrame, text: str, grams: int = 3
) -> DataFrame:
    """All (pattern, text) value pairs where the text contains the pattern, any case; see :func:`containing`.

    Both inputs are reduced to distinct values. Returns columns ``pattern`` and ``text`` with the original spelling.
    """
    t = texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    return containing(patterns, pattern, t, "text", grams).select("pattern", "text")


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, width: int = RANGE_WIDTH
) -> DataFrame:
    """Largest ``value`` (structs compare field by field, null is none) of the earlier rows of a key, the row itself not counted."""
    return running_maxima(df, keys, order, {out: value}, width)


def running_maxima(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], width: int = RANGE_WIDTH
) -> DataFrame:
    """:func:`running_max` of several values at once, each in the column that it is named by.

    ``order`` is a whole-number column, unique within a key. As in :func:`running_total` a key is
    dealt out in ranges of the order, whose own largest values are carried on.
    """
    keys, outs = list(keys), list(values)
    ranged = df.withColumn("_range", F.floor(F.col(order) / width).cast("bigint")).withColumns({f"_v_{c}": x for c, x in values.items()})
    tops = ranged.groupBy(*keys, "_range").agg(*[F.max(f"_v_{c}").alias(f"_t_{c}") for c in outs])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("_range").alias("_r"), *[F.max(f"_t_{c}").over(before).alias(f"_c_{c}") for c in outs]
    ).where(F.coalesce(*[F.when(F.col(f"_c_{c}").isNotNull(), 1) for c in outs]).isNotNull())
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    local = ranged.withColumns({f"_l_{c}": F.max(f"_v_{c}").over(inside) for c in outs}).join(carried, same, "left")
    both = {c: F.greatest(F.coalesce(f"_l_{c}", f"_c_{c}"), F.coalesce(f"_c_{c}", f"_l_{c}")) for c in outs}
    return local.select(*df.columns, *[x.alias(c) for c, x in both.items()])
