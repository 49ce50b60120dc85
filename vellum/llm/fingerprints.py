"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each five-word shingle (words lower-cased in A-Z) is hashed once. The top bits of
the hash name a bin, and a bin keeps its smallest hash. An empty bin copies the
bin that comes first in its own fixed random order of all bins and is not empty,
so any two texts with the same filled bins choose alike. Of each bin only the
eight low-order bits are stored, a byte for each of 256 bins. Two unlike bins
agree in those by chance once in 256, which :func:`likeness` corrects. (Fewer bits
fail on texts of a few words: their few bins are copied, a chance match with them.)

Defined cases: a null text is an empty one; a text without words has the empty
fingerprint, which is wholly like itself and unlike all others; a text of one to
four words has its whole sequence as its one shingle; equal texts have equal
fingerprints; rows with equal ids follow each other by hash of the text; a null
id comes last; a table of one row has itself as its next; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import slices, table
from vellum.llm.kernels import shingles

WIDTH = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 8
_BORDERS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)
_ORDER = np.random.default_rng(77).permuted(np.tile(np.arange(BINS, dtype=np.uint16), (BINS, 1)), axis=1)


def signature(hashes: np.ndarray) -> bytes:
    """Packed low-order bits of the bin minima of sorted distinct shingle hashes."""
    if len(hashes) == 0:
        return b""
    first = np.searchsorted(hashes, _BORDERS)
    filled = np.diff(first, append=len(hashes)) > 0
    low = np.zeros(BINS, np.uint8)
    low[filled] = (hashes[first[filled]] & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
    if not filled.all():
        full, empty = np.flatnonzero(filled), np.flatnonzero(~filled)
        low[empty] = low[full[np.argmin(_ORDER[np.ix_(empty, full)], axis=1)]]
    return low.tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimate of the Jaccard similarity of the shingles behind two fingerprints."""
    if not a or not b:
        return float(a == b)
    agree = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / BINS
    chance = 1 / (1 << LOW_BITS)
    return float(min(1.0, max(0.0, (agree - chance) / (1 - chance))))


def signatures(texts: list[str]) -> list[bytes]:
    """Fingerprints of texts, in pieces of bounded size."""
    out: list[bytes] = []
    for some in slices(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())})])):
        out += map(signature, shingles(some.column("text"), WIDTH))
    return out


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(names: list, texts: list[str], following: list[str]) -> list[tuple]:
    """Result rows of texts and the texts after them."""
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own, new = signatures(texts), signatures(changed)
    after = own[1:] + signatures(following[-1:]) if following[:-1] == texts[1:] else signatures(following)
    return [
        (d, len(t), hashlib.sha256(c.encode()).hexdigest(), o, e, likeness(o, e), likeness(o, n))
        for d, t, c, o, e, n in zip(names, texts, changed, own, new, after, strict=True)
    ]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_FIELDS = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _batch(rows: list[tuple], more: dict[str, list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _NAMES]
    arrays = [pa.array(list(c), t) for c, t in zip(columns, _FIELDS, strict=True)]
    extra = [pa.array(more["part"], pa.int64()), pa.array(more["end"], pa.int32()), pa.array(more["text"], pa.string())]
    return pa.RecordBatch.from_arrays(arrays + extra, names=[*_NAMES, "part", "end", "text"])


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text, its edit with the next text by descending id, and how like their fingerprints are.

    Ranges of ids are sorted apart. A task compares the rows inside its range and
    hands on its first and last text, and the ends of neighbouring ranges are
    joined afterwards.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, last, any_row = None, None, False
        for some in slices(batches):
            names, texts = some.column("doc_id").to_pylist(), [x or "" for x in some.column("text").to_pylist()]
            if not any_row:
                yield _batch([(names[0], *[None] * 6)], {"part": [part], "end": [1], "text": [texts[0]]})
            else:
                names, texts = [name, *names], [last, *texts]
            any_row = True
            if rows := _rows(names[:-1], texts[:-1], texts[1:]) if len(texts) > 1 else []:
                yield _batch(rows, {"part": [part] * len(rows), "end": [0] * len(rows), "text": [None] * len(rows)})
            name, last = names[-1], texts[-1]
        if any_row:
            yield _batch([(name, *[None] * 6)], {"part": [part], "end": [2], "text": [last]})

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for d, a, b in zip(*[some.column(c).to_pylist() for c in ("doc_id", "text", "following")], strict=True):
                rows = _rows([d], [a], [b])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _FIELDS, strict=True)], names=_NAMES)

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    done = table(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, RESULT + ", part bigint, end int, text string"),
        "fingerprints",
    )
    firsts = done.where("end = 1").select(F.col("part").alias("_part"), F.col("text").alias("following"))
    # two slim rows per range: which range comes after which
    parts = firsts.select("_part")
    order_of_parts = Window.orderBy("_part")
    after = parts.select(
        F.col("_part").alias("_own"),
        F.coalesce(F.lead("_part").over(order_of_parts), F.min("_part").over(Window.partitionBy())).alias("_part"),
    )
    borders = (
        done.where("end = 2")
        .select("doc_id", "text", F.col("part").alias("_own"))
        .join(after, "_own")
        .join(firsts, "_part")
        .select("doc_id", "text", "following")
        .mapInArrow(ends, RESULT)
    )
    return done.where("end = 0").select(*_NAMES).union(borders)


def printable(packed: str) -> Column:
    return F.lower(F.hex(F.col(packed)))


def from_printable(text: str) -> bytes:
    return bytes.fromhex(text)
