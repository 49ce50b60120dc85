"""BM25 of few query terms over many rows: each row of an index is scored where it lies, so no posting is moved."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from vellum import vocab

#: Sums (rows by queries) that a task holds at a time.
CELLS = 1 << 21
#: More than the last digits in which sums of equal parts may differ.
SLACK = 1e-8


def _kernel(asked: pa.Table, k: int | None, kept: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of batches of rows; ``asked`` has query_id, term, weight and avg_len."""
    asked = asked.combine_chunks()
    words = pc.unique(asked["term"])
    queries = pc.unique(asked["query_id"])
    word, query = pc.index_in(asked["term"], words).to_numpy(), pc.index_in(asked["query_id"], queries).to_numpy()
    order = np.argsort(word, kind="stable")
    query, weight = query[order], asked["weight"].to_numpy()[order]
    count = np.bincount(word, minlength=len(words))
    start = np.cumsum(count) - count
    n, avg_len = len(queries), asked["avg_len"][0].as_py() if len(asked) else 1.0
    k1, b = vocab.BM25_K1, vocab.BM25_B

    def scores(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Sums and numbers of met terms, rows by queries."""
        terms = rows.column("terms")
        at = np.repeat(np.arange(len(rows)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        code = pc.fill_null(pc.index_in(terms.flatten(), words), -1).to_numpy(zero_copy_only=False)
        hit = code >= 0
        at, code, tf = at[hit], code[hit], rows.column("tfs").flatten().to_numpy(zero_copy_only=False)[hit]
        dl = rows.column("dl").to_numpy(zero_copy_only=False)[at]
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_len))
        times = count[code]
        pair = np.arange(times.sum()) + np.repeat(start[code] - (np.cumsum(times) - times), times)
        cell = np.repeat(at, times) * n + query[pair]
        shape = (len(rows), n)
        sums = np.bincount(cell, weights=weight[pair] * np.repeat(part, times), minlength=len(rows) * n)
        return sums.reshape(shape), np.bincount(cell, minlength=len(rows) * n).reshape(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None if k is None else np.zeros((k, n))  # the task's best scores of each query so far
        for batch in batches:
            for rows in (batch.slice(i, max(1, CELLS // max(n, 1))) for i in range(0, len(batch), max(1, CELLS // max(n, 1)))):
                sums, met = scores(rows)
                good = met > 0
                if best is not None:
                    best = np.partition(np.concatenate([best, sums]), -k, axis=0)[-k:]
                    good &= sums >= best[0] - SLACK
                at, q = np.nonzero(good)
                columns = [queries.take(pa.array(q)), *[rows.column(c).take(pa.array(at)) for c in kept]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums[at, q]), pa.array(met[at, q].astype(np.int32))], ["query_id", *kept, "score", "matched"])

    return run


def scored(rows: DataFrame, asked: DataFrame, kept: Sequence[str], k: int | None) -> DataFrame:
    """``query_id``, the ``kept`` columns, ``score`` and the number of ``matched`` terms of each query and row that share a term.

    ``asked`` (query_id, term, weight, avg_len) is sent to all tasks, so the caller sees to its size. With ``k`` a task leaves out rows
    that are worse than ``k`` others of its own; the best ``k`` with all their equals are among the rest.
    """
    fields = [asked.schema["query_id"], *[rows.schema[c] for c in kept], StructField("score", DoubleType()), StructField("matched", IntegerType())]
    table = asked.select("query_id", "term", "weight", "avg_len").toArrow()
    some = rows.where("dl > 0").select(*kept, "terms", "tfs", *[c for c in ("dl",) if c not in kept])
    return some.mapInArrow(_kernel(table, k, tuple(kept)), StructType(fields))
