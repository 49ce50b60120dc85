"""Reproducible global shuffle and shards from a Feistel permutation of row numbers.

Rows are numbered 0..N-1 by id. A keyed permutation of 0..N-1 gives each row its
place in the shuffle; place ``p`` is slot ``p // shards`` of shard ``p % shards``.
Anyone who knows N, the key and the row number can compute shard and slot, and
:func:`row_at` goes back from them to the row number.

The permutation works on pairs from ``a * b`` values, the smallest such grid that
holds N: each round adds a keyed hash of one half to the other, modulo that
half's size. Numbers outside 0..N-1 are permuted again until they fall inside
(cycle walking); fewer than one in ``sqrt(N)`` needs it.

Defined cases: a null id sorts first; rows with the same id are ordered by hash
and size of the text, and rows that agree in all of these may swap; a null text
has size 16 and hash 0 as an empty one; an empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import table
from vellum.llm.kernels import mix

ROUNDS = 6


class Feistel:
    """A keyed permutation of the numbers below ``n``."""

    def __init__(self, n: int, key: int = 0) -> None:
        self.n = n
        self.a = max(1, isqrt(max(0, n - 1)) + 1)
        self.b = max(1, -(-n // self.a))
        keys = np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15) & (2**64 - 1))
        self.keys = mix(keys)

    def _step(self, half: np.ndarray, i: int, modulus: int) -> np.ndarray:
        return (mix(half.astype(np.uint64) + self.keys[i]) % np.uint64(modulus)).astype(np.int64)

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for i in range(ROUNDS):
            if i % 2:
                right = (right + self._step(left, i, self.b)) % self.b
            else:
                left = (left + self._step(right, i, self.a)) % self.a
        return left * self.b + right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for i in reversed(range(ROUNDS)):
            if i % 2:
                right = (right - self._step(left, i, self.b)) % self.b
            else:
                left = (left - self._step(right, i, self.a)) % self.a
        return left * self.b + right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, np.int64))
        while (outside := out >= self.n).any():
            out[outside] = step(out[outside])
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._once)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._back)


def row_at(n: int, shards: int, shard: int, slot: int, key: int = 0) -> int:
    """Row number that lies in a slot of a shard."""
    return int(Feistel(n, key).inverse(np.array([slot * shards + shard]))[0])


def numbered(rows: DataFrame, order: list[str], out: str = "row_number") -> DataFrame:
    """Number all rows from 0 in the given order: ranges are sorted apart, then shifted by the counts before them."""
    ordered = table(
        rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", 33))
        .withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    counts = ordered.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = counts.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        ordered.join(starts, F.col("_range") == F.col("_r"))
        .withColumn(out, F.col("_start") + F.col("_at"))
        .drop("_range", "_r", "_at", "_start")
    )


def permuted(number: str, n: int, key: int) -> Column:
    """Place of each row number in the shuffle."""

    @F.pandas_udf("bigint")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(Feistel(n, key).forward(x.to_numpy()))

    return place(F.col(number))


def shard(docs: DataFrame, shards: int, key: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, row_number, place, shard, slot`` of each row; shard sizes differ by one at most."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 16).cast("bigint").alias("size"),
        F.crc32(body).cast("bigint").alias("text_crc32"),
    )
    rows = numbered(slim, ["doc_id", "text_crc32", "size"])
    n = rows.count()
    placed = rows.withColumn("place", permuted("row_number", n, key))
    return placed.withColumn("shard", F.pmod(F.col("place"), F.lit(shards)).cast("int")).withColumn(
        "slot", F.floor(F.col("place") / shards).cast("bigint")
    )
