"""The trie of conversation prefixes, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns (role and text); its members are the
conversations that start with it. Prefixes get 128-bit names: running sums, modulo
2**128, of the digests of their turns mixed with the turn's place. A running sum over
sorted rows needs from earlier partitions only what their last conversation has added
up so far, so one conversation may be spread over many tasks.

Consecutive nodes with the same members are one *segment*, the chain between two
branchings: smallest member and number of members name it, its lower end is where its
children hang, and there are at most two segments a conversation. Totals of subtrees
are passed up between segments. Those with more than the square root of all rows as
members are the *crown*: each of its nodes stands for so many rows, and no row twice in a
level, so the crown has at most as many nodes, which bounds what is broadcast and what the
last pass reads. Cutting it off leaves subtrees of at most twice that many segments, the
shards. A shard's segments are sorted in reverse level order; each takes the messages
addressed to it from a priority queue, adds up its total, and leaves a message to its
parent, which comes later in the order. Shard roots send theirs across; they are added up
for each receiver, and the same pass goes over the crown.

Defined cases: a row without conversation id belongs to none and is left out; null turns
come first, equal turns are ordered by role, then text; null role or text is empty; a
conversation without turns is a member of the root; an empty table has no nodes; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import table
from vellum.llm.kernels import mix

#: Messages that a queue keeps in memory before it writes them to a sorted run.
QUEUE = 1 << 17
#: Conversation ids joined into one piece of a node's list.
PIECE = 4096
#: A conversation takes turns of the one whose id is the next lower multiple of this, and fewer than MOST of them.
FAMILY, MOST = 5, 9
NODE = ["depth", "k1", "k2"]


# ---- running sums over sorted rows


def _runs(conv: np.ndarray) -> np.ndarray:
    """Where a new conversation starts."""
    return np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation within this partition."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        starts = _runs(conv)
        sizes = np.diff(np.append(starts, len(conv)))
        at = np.arange(1, len(conv) + 1) - np.repeat(starts, sizes)
        if last == conv[0]:
            at[: sizes[0]] += count
        last, count = conv[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(conv), part, np.int64)), pa.array(at), *batch.columns], names=["part", "at", *batch.schema.names]
        )


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of turn digests and bytes up to each turn of a conversation, within this partition."""
    part, last, held = TaskContext.get().partitionId(), None, np.zeros(3, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, depth = (batch.column(c).to_numpy() for c in ("conv_id", "depth"))
        digest = np.frombuffer(batch.column("digest").cast(pa.binary(16)).buffers()[1], np.uint64)
        digest = digest[2 * batch.column("digest").offset :][: 2 * len(conv)].reshape(-1, 2)
        place = mix(depth.astype(np.uint64))
        own = np.stack([mix(digest[:, 0] + place), mix(digest[:, 1] ^ mix(place)), batch.column("n_bytes").to_numpy().astype(np.uint64)])
        sums = np.cumsum(own, axis=1, dtype=np.uint64)
        starts = _runs(conv)
        before = sums[:, starts] - own[:, starts]
        if last == conv[0]:
            before[:, 0] -= held
        sums -= np.repeat(before, np.diff(np.append(starts, len(conv))), axis=1)
        last, held = conv[-1], sums[:, -1].copy()
        columns = [np.full(len(conv), part, np.int64), *sums.view(np.int64), *own[:2].view(np.int64)]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), *(batch.column(c) for c in ("conv_id", "depth", "n_bytes", "last"))],
            names=["part", "k1", "k2", "bytes_to", "o1", "o2", "conv_id", "depth", "n_bytes", "last"],
        )


def _carried(rows: DataFrame, order: str, sums: list[str]) -> dict[int, tuple[int, list[int]]]:
    """What the first conversation of each partition has from earlier ones; one row a partition comes to the driver."""
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", order, *[c for c in sums if c != order])).alias("end"))
    out, conv, held = {}, None, [0] * len(sums)
    for r in sorted(ends.collect()):
        found = [r.end[c] for c in sums]
        if conv == r.first:
            out[r.part] = (r.first, held)
        if conv == r.end.conv_id:
            held = [a + b for a, b in zip(held, found, strict=True)]
        else:
            conv, held = r.end.conv_id, found
    return out


def _ranked(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, rank, digest, n_bytes`` of every turn."""
    some = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    some = some.repartitionByRange(*order).sortWithinPartitions(*order)
    some = some.select("conv_id", digest.alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    rows = table(some.mapInArrow(_number, "part bigint, at bigint, conv_id bigint, digest binary, n_bytes bigint"), "turns")
    carried = [(p, c, h[0]) for p, (c, h) in _carried(rows, "at", ["at"]).items()]
    if not carried:
        return rows.withColumnRenamed("at", "rank")
    more = turns.sparkSession.createDataFrame(carried, "part bigint, conv_id bigint, more bigint")  # at most one row a partition
    rank = F.col("at") + F.coalesce("more", F.lit(0))
    return rows.join(F.broadcast(more), ["part", "conv_id"], "left").withColumn("rank", rank)


def _shared(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: ``conv_id, length`` of each, and their turns ``conv_id, depth, digest, n_bytes, last``."""
    sizes = ranked.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % MOST).alias("h"))
    convs = convs.join(heads, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = table(convs.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    rows = ranked.select("conv_id", "rank", "digest", "n_bytes")
    own = rows.join(convs, "conv_id").where(F.col("rank") > F.col("h")).withColumn("depth", F.col("m") + F.col("rank") - F.col("h"))
    taken = rows.where((F.col("rank") < MOST) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    taken = taken.join(convs, "base").where(F.col("rank") <= F.col("h")).withColumn("depth", F.col("rank"))
    columns = ["conv_id", "depth", "digest", "n_bytes", (F.col("depth") == F.col("length")).alias("last")]
    return convs.select("conv_id", "length"), own.select(*columns).unionByName(taken.select(*columns))


def _named(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id, depth, k1, k2, p1, p2, n_bytes, bytes_to, last``: the name of each prefix and of its parent."""
    order = ["conv_id", "depth"]
    found = turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _add_up,
        "part bigint, k1 bigint, k2 bigint, bytes_to bigint, o1 bigint, o2 bigint, conv_id bigint, depth bigint, n_bytes bigint, last boolean",
    )
    rows = table(found, "prefixes")
    carried = _carried(rows, "depth", ["k1", "k2", "bytes_to"])
    top = 1 << 64

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, conv = (batch.column(c).to_numpy() for c in ("part", "conv_id"))
            sums = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("k1", "k2", "bytes_to")])
            for p in np.unique(part).tolist():
                if p in carried:
                    first, held = carried[p]
                    sums[:, (part == p) & (conv == first)] += np.array([[x % top] for x in held], np.uint64)
            own = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("o1", "o2")])
            numbers = [*sums.view(np.int64), *(sums[:2] - own).view(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, numbers), *(batch.column(c) for c in ("conv_id", "depth", "n_bytes", "last"))],
                names=["k1", "k2", "bytes_to", "p1", "p2", "conv_id", "depth", "n_bytes", "last"],
            )

    kept = rows.mapInArrow(carry, "k1 bigint, k2 bigint, bytes_to bigint, p1 bigint, p2 bigint, conv_id bigint, depth bigint, n_bytes bigint, last boolean")
    return table(kept, "names")


# ---- time-forward processing


class Queue:
    """Least item first; items are tuples of six whole numbers.

    Beyond ``most`` items in memory all are written as one sorted run to a file without
    a name in Spark's own spill folder, which is gone with the task. Every run is read
    once, from its start to its end.
    """

    ITEM = struct.Struct("<6q")

    def __init__(self, most: int = QUEUE) -> None:
        self.most, self.held, self.heads, self.runs = most, [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.held, item)
        if len(self.held) > self.most:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            run = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
            for x in sorted(self.held):
                run.write(self.ITEM.pack(*x))
            run.seek(0)
            self.held = []
            self.runs.append(run)
            self._next(len(self.runs) - 1)

    def _next(self, k: int) -> None:
        some = self.runs[k].read(self.ITEM.size)
        if some:
            heapq.heappush(self.heads, (self.ITEM.unpack(some), k))
        else:
            self.runs[k].close()

    def pop_to(self, address: tuple) -> Iterator[tuple]:
        """Take out all items that start with the address."""
        n = len(address)
        while True:
            least = self.held[0] if self.held else None
            if self.heads and (least is None or self.heads[0][0] < least):
                item, k = self.heads[0]
                if item[:n] != address:
                    return
                heapq.heappop(self.heads)
                self._next(k)
            else:
                if least is None or least[:n] != address:
                    return
                item = heapq.heappop(self.held)
            yield item

    def empty(self) -> bool:
        return not self.held and not self.heads


SEGMENT = "s1 bigint, s2 bigint, bottom bigint, k1 bigint, k2 bigint, top bigint, p1 bigint, p2 bigint, inner boolean, weight bigint, conv_id bigint, n_convs bigint, before bigint, leaves bigint, saved bigint, children bigint"
SEGMENT_COLUMNS = [x.split()[0] for x in SEGMENT.split(", ")]


def passed_up(batches: Iterator[pa.RecordBatch], most: int = QUEUE) -> Iterator[pa.RecordBatch]:
    """Segments in reverse level order, shard by shard, with the totals of their subtrees.

    ``leaves, saved`` and ``children`` are what came from other shards; the subtree's own is
    added. A segment whose parent is in the same shard is ``inner``.
    """
    shard, queue = None, Queue(most)
    for batch in batches:
        out = []
        rows = zip(*(batch.column(c).to_pylist() for c in SEGMENT_COLUMNS), strict=True)
        for s1, s2, bottom, k1, k2, top, p1, p2, inner, weight, *names, leaves, saved, children in rows:
            if shard != (s1, s2):
                if not queue.empty():
                    raise ValueError("a message to a segment that is not there")
                shard = (s1, s2)
            for item in queue.pop_to((-bottom, k1, k2)):
                leaves, saved, children = leaves + item[3], saved + item[4], children + item[5]
            leaves, saved = max(leaves, 1), saved + weight
            if inner:
                queue.push((1 - top, p1, p2, leaves, saved, 1))
            out.append((s1, s2, bottom, k1, k2, top, p1, p2, inner, weight, *names, leaves, saved, children))
        if out:
            kinds = [pa.bool_() if c == "inner" else pa.int64() for c in SEGMENT_COLUMNS]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=SEGMENT_COLUMNS)


def _segments(nodes: DataFrame) -> DataFrame:
    start = F.min_by(F.struct("p1", "p2", F.col("k1").alias("f1"), F.col("k2").alias("f2"), (F.col("bytes_to") - F.col("n_bytes")).alias("before")), "depth")
    end = F.max_by(F.struct("k1", "k2", "bytes_to"), "depth")
    found = nodes.groupBy("conv_id", "n_convs").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), start.alias("start"), end.alias("end"))
    weight = (F.col("n_convs") - 1) * (F.col("end.bytes_to") - F.col("start.before"))
    return found.select("conv_id", "n_convs", "top", "bottom", "start.*", "end.k1", "end.k2", weight.alias("weight"))


def _totals(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every segment with ``leaves, saved, children`` of its subtree and ``parent_conv_id``."""
    most = max(1, math.isqrt(rows.count()))
    crowned = (F.col("n_convs") > most) | (F.col("top") == 0)
    segments = table(_segments(nodes).withColumn("crowned", crowned), "segments")
    # at most a node for each `most` rows, and the root
    crown = nodes.where((F.col("n_convs") > most) | (F.col("depth") == 0)).select(*NODE)
    above = crown.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    roots = rows.join(F.broadcast(above), ["depth", "p1", "p2"], "left_semi").join(F.broadcast(crown), NODE, "left_anti")
    roots = roots.select("conv_id", F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    none = {c: F.lit(0).cast("bigint") for c in ("leaves", "saved", "children")}
    inner = (F.col("f1") != F.col("s1")) | (F.col("f2") != F.col("s2"))
    low = segments.where(~F.col("crowned")).join(roots, "conv_id").withColumns(none | {"inner": inner}).select(*SEGMENT_COLUMNS)
    order = ["s1", "s2", F.col("bottom").desc(), "k1", "k2"]
    low = table(low.repartition("s1", "s2").sortWithinPartitions(*order).mapInArrow(passed_up, SEGMENT), "shards")
    sent = low.where(~F.col("inner")).groupBy((F.col("top") - 1).alias("bottom"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    sent = sent.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("children"))
    high = segments.where("crowned").join(sent, ["bottom", "k1", "k2"], "left").fillna(0, ["leaves", "saved", "children"])
    high = high.withColumns({"s1": F.lit(0).cast("bigint"), "s2": F.lit(0).cast("bigint"), "inner": F.col("top") > 0}).select(*SEGMENT_COLUMNS)
    high = table(high.repartition(1).sortWithinPartitions(*order).mapInArrow(passed_up, SEGMENT), "crown")
    # a parent with many children is in the crown
    ends = [F.col("bottom").alias("_depth"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("conv_id").alias("parent_conv_id")]
    same = (F.col("top") - 1 == F.col("_depth")) & (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2"))
    of_crown = low.where(~F.col("inner")).unionByName(high).join(F.broadcast(high.select(*ends)), same, "left")
    of_shards = low.where("inner").join(low.select(*ends), same)
    return of_crown.unionByName(of_shards).select(
        "conv_id", "n_convs", "top", "bottom", "before", "parent_conv_id", F.col("leaves").alias("n_leaves"), F.col("saved").alias("_saved"), "children"
    )


# ---- lists of the conversations that end in a node


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join sorted ids of one node into pieces."""
    node, first, ids = None, None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(NODE, node, strict=True)) | {"first": first, "ids": ",".join(map(str, ids))}], schema=kind)

    kind = pa.schema([*((c, pa.int64()) for c in NODE), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        for *at, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if at != node or len(ids) >= PIECE:
                if ids:
                    yield piece()
                node, first, ids = at, conv, []
            ids.append(conv)
    if ids:
        yield piece()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, in order."""
    node, hashed = None, None
    kind = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])
    for batch in batches:
        out = []
        for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if at != node:
                if node:
                    out.append(dict(zip(NODE, node, strict=True)) | {"ends_sha256": hashed.hexdigest()})
                node, hashed = at, hashlib.sha256()
            else:
                hashed.update(b",")
            hashed.update(ids.encode())
        yield pa.RecordBatch.from_pylist(out, schema=kind)
    if node:
        yield pa.RecordBatch.from_pylist([dict(zip(NODE, node, strict=True)) | {"ends_sha256": hashed.hexdigest()}], schema=kind)


def _ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """SHA-256 of the list of conversations that end in a node; a task of a node reads its ids in pieces of thousands."""
    zero = F.lit(0).cast("bigint")
    ends = rows.where("last").select(*NODE, "conv_id")
    ends = ends.unionByName(convs.where("length = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
    order = [*NODE, "conv_id"]
    names = "depth bigint, k1 bigint, k2 bigint"
    joined = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, f"{names}, first bigint, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashes, f"{names}, ends_sha256 string")


def trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a node of the trie of all rebuilt conversations.

    ``conv_id, depth`` name it (its smallest member), with ``parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens`` and ``ends_sha256`` of the conversations that end in it.
    """
    convs, rebuilt = _shared(_ranked(turns, conv_id, turn, role, text))
    rows = _named(rebuilt)
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("n_bytes", "bytes_to", "p1", "p2")]
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zeros = {c: F.lit(0).cast("bigint") for c in (*NODE, "n_bytes", "bytes_to", "p1", "p2")}
    nodes = table(nodes.unionByName(root.withColumns(zeros)), "nodes")
    found = nodes.join(_totals(rows, nodes), ["conv_id", "n_convs"]).join(_ends(rows, convs), NODE, "left")
    above = (F.col("n_convs") - 1) * (F.col("bytes_to") - F.col("n_bytes") - F.col("before"))
    return found.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(F.col("depth") < F.col("bottom"), F.lit(1).cast("bigint")).otherwise(F.col("children")).alias("n_children"),
        "n_leaves",
        (F.col("_saved") - above).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
