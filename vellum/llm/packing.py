"""Best-fit packing of documents into sequences of bounded length.

Documents become token ids plus an end id; one longer than the limit is cut into
full pieces, its first piece taking what remains. Both sides of the match are
range-sorted by size: the pieces, and the gaps at the end of the sequences.
Sizes are whole numbers up to the limit, so each side is at most that many runs
of equal size, however large the corpus; the rows of a run are told apart by
their rank, which Spark counts in chunks.

The match goes in supersteps, one per piece size from the largest down. A step
looks up the successor of the size among the gaps, gives the pieces to the gaps
of that run in rank order (so no two want the same gap), shrinks those gaps, and
repeats with the next gap until the run of pieces is placed, opening sequences
where no gap is wide enough. A step of this sweep moves a whole run. The steps
form a table of rank ranges that Spark joins back to the pieces by size and rank.

Defined cases: a null or empty text is one piece, the end id; repeated rows are
packed each for itself; a null id is packed too; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import slices, table
from vellum.llm.tokens import SLICE, encoder

PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
CHUNK_ROWS = 20_000


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids."""
    if n <= limit:
        return [(0, n)]
    first = n % limit or limit
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


def pieces(docs: DataFrame, limit: int = 2048, end_id: int = 0, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=SLICE):
            rows: list[tuple] = []
            names = part.column("doc_id").to_pylist()
            for name, ids in zip(names, encoder(tokenizer).encode(part.column("text")), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), limit)):
                    rows.append((name, k, start, n, zlib.crc32(ids[start : start + n].data)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECE, strict=True)], schema=PIECE
            )

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def sweep(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """The steps of the match: size, first rank, sequences, pieces for each, first sequence, place in them.

    Step ``(s, r, k, m, q, at)`` puts the pieces of size ``s`` and rank ``r`` to
    ``r + k*m - 1``, ``m`` to a sequence, into sequences ``q`` to ``q + k - 1``
    from place ``at`` on.
    """
    gaps: list[deque[tuple[int, int]]] = [deque() for _ in range(limit + 1)]
    wide = 0  # bit g: there are gaps of width g
    steps = []
    opened = 0

    def put(width: int, first: int, n: int, front: bool = False) -> None:
        nonlocal wide
        if width and n:
            (gaps[width].appendleft if front else gaps[width].append)((first, n))
            wide |= 1 << width

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            fits = wide >> size
            if fits:
                width = size + (fits & -fits).bit_length() - 1
                first, n = gaps[width].popleft()
                if not gaps[width]:
                    wide &= ~(1 << width)
            else:
                width, first, n = limit, opened, -(-left // (limit // size))
                opened += n
            each = width // size
            for k, m in ((min(n, left // each), each), (1, left % each)):
                if k and m and n and left and (m == each or left < each):
                    steps.append((size, rank, k, m, first, limit - width))
                    put(width - m * size, first, k)
                    rank, left, first, n = rank + k * m, left - k * m, first + k, n - k
            put(width, first, n, front=True)
    return steps


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """0-based ``rank`` of each piece among those of its length, counted in chunks so that no task gets a whole length."""
    chunks = total // CHUNK_ROWS + 1
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    sums = dealt.groupBy("length", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("length").alias("_l"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("_at", F.row_number().over(inside) - 1)
        .join(starts, (F.col("length") == F.col("_l")) & (F.col("_chunk") == F.col("_c")))
        .withColumn("rank", F.col("_start") + F.col("_at"))
        .select(*rows.columns, "rank")
    )


def pack(docs: DataFrame, limit: int = 2048, end_id: int = 0, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see the module's text."""
    rows = table(pieces(docs, limit, end_id, tokenizer, doc_id, text), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `limit` rows at most
    steps = sweep(counts, limit)
    plan = docs.sparkSession.createDataFrame(
        steps or [(0, 0, 0, 0, 0, 0)], "_size bigint, _rank bigint, _k bigint, _each bigint, _first bigint, _place bigint"
    )
    inside = (F.col("length") == F.col("_size")) & (F.col("rank") >= F.col("_rank")) & (F.col("rank") < F.col("_rank") + F.col("_k") * F.col("_each"))
    nth = F.col("rank") - F.col("_rank")
    return (
        ranked(rows, sum(counts.values()))
        .join(plan, inside)
        .withColumn("sequence_id", F.col("_first") + F.floor(nth / F.col("_each")).cast("bigint"))
        .withColumn("offset", F.col("_place") + F.pmod(nth, F.col("_each")) * F.col("length"))
        .select(*rows.columns, "sequence_id", "offset")
    )
