"""Token-id output as Arrow files of equal-length sequences, and reading them back.

A shard ``part-N.arrow`` is an Arrow IPC file. Its record batches have two
fixed-size-list columns: ``ids`` (uint16 where the vocabulary fits, else uint32)
and ``mask`` (bits, set where an id is, not in the padding of the shard's last
sequence). All lists have the same length,
so sequence ``i`` lies at a computable place and a memory map gives it without
copying. Documents follow each other without gaps in ascending id order;
``part-N.index.arrow`` says where each starts in its shard. Shard numbers follow
the id order.

A task writes under a name of its own and then renames, so a task that is run
again after a lost executor puts the same file in place.

Defined cases: a null or empty text is its end id alone; equal ids are ordered by
hash of the text; a null id comes first; an empty table writes no shard and reads
as no rows; other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import new_path, slices, table
from vellum.llm.tokens import SLICE, encoder

BATCH_SEQUENCES = 256
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(length: int, kind: type) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """Writes one shard; ids are kept in memory for one record batch only."""

    def __init__(self, folder: str, part: int, length: int, kind: type) -> None:
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.to = [f"{root}/part-{part:06d}.arrow", f"{root}/part-{part:06d}.index.arrow"]
        self.own = [f"{x}.{uuid.uuid4().hex}" for x in self.to]
        self.length, self.kind, self.schema = length, kind, _schema(length, kind)
        self.files = [self.fs.open_output_stream(x) for x in self.own]
        self.out = [pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, INDEX), strict=True)]
        self.waiting: list[np.ndarray] = []
        self.held = self.total = self.docs = 0

    def _flush(self, last: bool) -> None:
        full = BATCH_SEQUENCES * self.length
        if self.held < full and not (last and self.held):
            return
        flat = np.concatenate(self.waiting)
        n = len(flat) if last else len(flat) // full * full
        for at in range(0, n, full):
            ids = flat[at : min(at + full, n)]
            padded = -len(ids) % self.length
            mask = np.repeat([True, False], [len(ids), padded])
            ids = np.concatenate([ids, np.zeros(padded, self.kind)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
            self.out[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.waiting, self.held = [flat[n:]], len(flat) - n

    def add(self, names: pa.Array, texts: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in texts], np.int64)
        starts = self.total + np.cumsum(sizes) - sizes
        self.out[1].write_batch(pa.RecordBatch.from_arrays([names, pa.array(starts), pa.array(sizes)], schema=INDEX))
        self.waiting += texts
        self.held += int(sizes.sum())
        self.total += int(sizes.sum())
        self.docs += len(texts)
        self._flush(last=False)

    def close(self) -> None:
        self._flush(last=True)
        for x in (*self.out, *self.files):
            x.close()
        for a, b in zip(self.own, self.to, strict=True):
            try:
                self.fs.move(a, b)
            except OSError:  # another attempt of this task has put the same file there
                if self.fs.get_file_info(b).type != pafs.FileType.File:
                    raise


class Shard:
    """Random access to the sequences and documents of one shard."""

    def __init__(self, folder: str, part: int) -> None:
        fs, root = pafs.FileSystem.from_uri(folder)
        local = isinstance(fs, pafs.LocalFileSystem)

        def opened(path: str) -> pa.ipc.RecordBatchFileReader:
            return pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))

        self.sequences = opened(f"{root}/part-{part:06d}.arrow")
        self.index = opened(f"{root}/part-{part:06d}.index.arrow")
        self.length = self.sequences.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def _flat(self, batch: int) -> pa.RecordBatch:
        if batch != self._at:
            self._at, self._batch = batch, self.sequences.get_batch(batch)
        return self._batch

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``, as views into the file."""
        batch, row = self._flat(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
        ids = batch.column("ids").values.to_numpy()[row * self.length : (row + 1) * self.length]
        return ids, batch.column("mask").values.slice(row * self.length, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard on; a view if one record batch has them all."""
        full, out = BATCH_SEQUENCES * self.length, []
        while n:
            at = start % full
            some = self._flat(start // full).column("ids").values.to_numpy()[at : min(full, at + n)]
            out.append(some)
            start, n = start + len(some), n - len(some)
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, np.uint16)])


def write(docs: DataFrame, folder: str, length: int = 2048, end_id: int = 2, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents; returns the shards: ``part, n_docs, n_tokens`` and ``base``, the ids in earlier shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out = None
        for some in slices(batches, most=SLICE):
            out = out or Writer(folder, part, length, encoder(tokenizer).type)
            texts = encoder(tokenizer).encode(some.column("text"))
            out.add(some.column("doc_id"), [np.append(x, end_id).astype(out.kind) for x in texts])
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [out.docs], "n_tokens": [out.total]})

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    written = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, "part bigint, n_docs bigint, n_tokens bigint")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return table(written, "shards").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(spark: SparkSession, shards: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, taken from the files; ``start`` counts all shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["part"])
                for k in range(shard.index.num_record_batches):
                    some = shard.index.get_batch(k)
                    starts, sizes = (some.column(c).to_numpy() for c in ("start", "n_tokens"))
                    sums = [zlib.crc32(shard.ids(a, n).astype("<u4").data) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [some.column("doc_id"), pa.array(starts + row["base"]), pa.array(sizes), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = shards.select("part", "base").repartition(max(1, spark.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encoded(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write all documents to token files and read every document back from them."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    return read(spark, write(docs, folder, **options), folder)
