"""N-gram Jaccard join by parity sketches, and the groups that its links form.

Every distinct shingle of a document flips one bit of a sketch, chosen by its
hash. Two sketches differ in at most as many bits as the sets have elements in
only one of them. For two sets that meet the similarity, that number has a bound
``d`` which follows from their sizes alone; so of ``d + 3`` words that a sketch
is cut into, three at least are equal in both, and a join on (size band, place of
the word, word) finds the pair. Candidates are then compared by the Hamming
distance of their whole sketches, and what passes is verified on whole sets.

Words of few elements are equal in very many unlike sets. In sketches of fewer
than 24 words a word of no or one element is joined together with each word of a
second, independent sketch, of which two similar sets share one at least too. In
longer ones such light words are left out, and the longer the sketch, the more
elements a word must have: so that a pair at the very threshold, of whose words
about 40 in 100 are equal, shares 8 of those kept on average in the shortest
sketches and 16 in the others. It is missed only if it happens to share none,
less than once in 1,000 to 1,000,000 such pairs; nearer pairs still less. Else the
result is exact up to equal 64-bit hashes of shingles.

Size bands: band ``i`` has the sizes from ``edges[i]`` on. A document also enters
the band below if a smaller set there could still meet the similarity. Bands with
``d = 0`` need no join: only equal sets link there.

Large groups of copies: equal sets are one class with one representative, before
the join. Near copies share many words: each set is first compared with the
representative of the bucket that it shares most words with, and what is then
linked to one component needs no more comparing. Of a bucket with several
components left all pairs are compared if it is small. Members of large ones are
told by their differences from a centre, the set of their band that shares words
with most others. Two sets that are similar differ from it in the same elements,
but for few, or else both are similar to it; so a join on the rarest elements of
the differences finds the pairs, and edits of one text that went different ways
never meet. All found pairs are verified. So no link between components is lost.

Defined cases: a text without words (or null) has the empty set and no links; a
text with fewer words than the shingle is one shingle; repeated rows and equal
ids are one node (linked by whatever text of it links); a row with a null id
gets its size, a null component and no links; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import slices, small_batches, table
from vellum.llm.graph import components
from vellum.llm.kernels import mix, shingles

U64 = np.uint64


#: Words by which a sketch has more than the differing elements; so many at least are untouched in both of a pair.
SPARE = 3
#: Sketches of at least so many words leave out light words; shorter ones refine them.
LONG = 24
#: Words that a sketch must have for its lightest joined words to need one element more than two, three, and so on.
HEAVIER = np.array([48, 96, 192, 400, 800])


class Bands:
    """Size bands and the number of sketch words of each, for similarity ``num / den``."""

    def __init__(self, num: int, den: int, ratio: float = 1.3) -> None:
        self.num, self.den = num, den
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * ratio)))
        self.differing = [self.most_differing(hi - 1) for hi in self.edges[1:]]

    def most_differing(self, a: int) -> int:
        """Most elements that only one of two similar sets has, the smaller of size ``a``."""
        b = a * self.den // self.num
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def own(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def words(self, band: int) -> int:
        return self.differing[band] + SPARE

    def of(self, n: int) -> list[int]:
        """The bands that a set of ``n`` elements enters and that need a join."""
        own = self.own(n)
        out = [own] if self.differing[own] else []
        if own and (self.edges[own] - 1) * self.den >= n * self.num and self.differing[own - 1]:
            out.append(own - 1)
        return out


def sketch(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``words`` 64-bit parity words of sorted distinct hashes, and the elements of each.

    The top bits of a hash name the word, the low six the bit.
    """
    place = (hashes >> U64(32)) * U64(words) >> U64(32)  # rises with the hash
    borders = np.searchsorted(place, np.arange(words + 1, dtype=np.uint64))
    running = np.zeros(len(hashes) + 1, np.uint64)
    np.bitwise_xor.accumulate(U64(1) << (hashes & U64(63)), out=running[1:])
    return running[borders[1:]] ^ running[borders[:-1]], np.diff(borders)


def keys(hashes: np.ndarray, bands: Bands, band: int) -> np.ndarray:
    """Join keys of a set in a band: hashes of band, place and word of its sketch words."""
    out = [np.zeros(0, np.uint64)]
    if len(hashes):
        words, elements = sketch(hashes, bands.words(band))
        found = mix(words + mix(np.arange(len(words), dtype=np.uint64) + U64(band << 40)))
        weak = elements < 2 + np.searchsorted(HEAVIER, len(words), "right")
        out.append(found[~weak])
        if len(words) < LONG and weak.any():
            other, _ = sketch(np.sort(mix(hashes + U64(0x5851F42D4C957F2D))), bands.differing[band] + 1)
            other = mix(other + mix(np.arange(len(other), dtype=np.uint64) + U64(1 << 56)))
            out.append(mix(found[weak][:, None] + other[None, :]).ravel())
    return np.concatenate(out)


def sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b``: size and 128-bit digest of each document's shingle set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            found = shingles(some.column("text"), width)
            digests = np.frombuffer(b"".join(hashlib.blake2b(x.data, digest_size=16).digest() for x in found), np.int64)
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(digests[0::2]), pa.array(digests[1::2])],
                names=["doc_id", "n_shingles", "set_a", "set_b"],
            )

    return docs.mapInArrow(work, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint")


def sketch_words(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """``key, band, doc_id`` for each sketch word; of equal sets in a task only the first is given."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for some in slices(batches):
            rows = []
            for name, found in zip(some.column("doc_id").to_pylist(), shingles(some.column("text"), width), strict=True):
                if name is None or len(found) == 0:
                    continue
                digest = hashlib.blake2b(found.data, digest_size=16).digest()
                if digest not in seen:
                    seen.add(digest)
                    rows += [(name, band, keys(found, bands, band)) for band in bands.of(len(found))]
            counts = [len(k) for _, _, k in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.uint64), *(k for _, _, k in rows)]).view(np.int64)),
                    pa.array(np.repeat(np.array([b for _, b, _ in rows], np.int32), counts)),
                    pa.array(np.repeat(np.array([n for n, _, _ in rows], np.int64), counts)),
                ],
                names=["key", "band", "doc_id"],
            )

    return docs.mapInArrow(work, "key bigint, band int, doc_id bigint")


def shared_words(words: DataFrame) -> DataFrame:
    """The rows of ``key, band, doc_id`` whose key some other document has too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by key and id; the last row of a batch waits for the next one
        rest, given = None, False
        for some in batches:
            rows = [some.column(c).to_numpy() for c in ("key", "band", "doc_id")]
            if len(rows[0]) == 0:
                continue
            if rest is not None:
                rows = [np.concatenate([[r], x]) for r, x in zip(rest, rows, strict=True)]
            key, _, name = rows
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            key, band, name = (x[new] for x in rows)
            twin = np.zeros(len(key), bool)
            twin[1:] = key[1:] == key[:-1]
            give = twin.copy()
            give[:-1] |= twin[1:]
            if given:
                give[0] = False  # was given with the batch before
            given = bool(give[-1]) or (given and len(key) == 1)
            rest = [x[-1] for x in (key, band, name)]
            yield pa.RecordBatch.from_arrays([pa.array(key[give]), pa.array(band[give].astype(np.int32)), pa.array(name[give])], names=["key", "band", "doc_id"])

    return words.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(work, "key bigint, band int, doc_id bigint")


def sketches(texts: DataFrame, width: int, bands: Bands) -> DataFrame:
    """``doc_id, band, n, sketch`` of each band that a document enters."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            rows = []
            for name, found in zip(some.column("doc_id").to_pylist(), shingles(some.column("text"), width), strict=True):
                rows += [(name, b, len(found), sketch(found, bands.words(b))[0].tobytes()) for b in (bands.of(len(found)) if len(found) else [])]
            names, types = ["doc_id", "band", "n", "sketch"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return texts.mapInArrow(work, "doc_id bigint, band int, n bigint, sketch binary")


def near(pairs: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """The ``a, b, band`` pairs whose sketches differ in no more bits than similar sets of their sizes may."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            n = some.column("na").to_numpy() + some.column("nb").to_numpy()
            most = (n * (den - num) // (den + num)).tolist()
            keep = np.zeros(some.num_rows, bool)
            for i, (x, y) in enumerate(zip(some.column("sa"), some.column("sb"), strict=True)):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                keep[i] = int(np.bitwise_count(u ^ v).sum()) <= most[i]
            yield pa.RecordBatch.from_arrays([some.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    left = known.select(F.col("doc_id").alias("a"), "band", F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = known.select(F.col("doc_id").alias("b"), "band", F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, ["a", "band"]).join(right, ["b", "band"])
    close = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    return both.where(close).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(work, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The ``a, b`` pairs whose whole sets meet the similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "ta"):
            keep = np.zeros(some.num_rows, bool)
            for i, (u, v) in enumerate(zip(shingles(some.column("ta"), width), shingles(some.column("tb"), width), strict=True)):
                both = np.sort(np.concatenate([u, v]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = common * den >= (len(u) + len(v) - common) * num
            yield pa.RecordBatch.from_arrays([some.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(work, "a bigint, b bigint").distinct()


def representatives(found: DataFrame) -> DataFrame:
    """``doc_id, rep``: the smallest id among the documents with the same set."""
    named = found.where("doc_id is not null and n_shingles > 0")
    reps = named.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    return named.join(reps, ["set_a", "set_b", "n_shingles"]).select("doc_id", "rep", "n_shingles")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


#: Up to this number the ids of documents with candidates are broadcast (16 MB) to pick their texts.
BROADCAST_ROWS = 2_000_000


def centres(large: DataFrame) -> DataFrame:
    """``band, node, root, centre`` of ``key, band, node, root``: what common keys of a band tie together has one centre, the set with most company."""
    per_key = large.groupBy("key").agg(F.min("node").alias("_lo"), F.count("*").alias("_size"))
    met = large.join(per_key, "key").groupBy("band", "node", "root", "_lo").agg(F.sum("_size").alias("_size"))
    met = table(met.withColumns({"at": F.struct("band", "node"), "lo": F.struct("band", F.col("_lo").alias("node"))}), "met")
    cluster = table(components(met, "at", "lo").select(F.col("node").alias("at"), F.col("root").alias("cluster")), "clusters")
    company = met.groupBy("at", "band", "node", "root").agg(F.sum("_size").alias("_size")).join(cluster, "at")
    middle = company.groupBy("cluster").agg(F.max_by("node", F.struct("_size", -F.col("node"))).alias("centre"))
    return company.join(middle, "cluster").select("band", "node", "root", "centre")


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come often within slices of the texts, at most ``COMMON`` of them by hash, and how often.

    They only decide an order in which shingles are looked at, whatever they are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["key", "n"])

        held: list[np.ndarray] = []
        for some in slices(batches):
            held += shingles(some.column("text"), width)
            if sum(map(len, held)) > COUNTED:
                yield counted()
                held = []
        if held:
            yield counted()

    some = texts.select("text").mapInArrow(work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    rows = some.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    key, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def differences(nodes: DataFrame, texts: DataFrame, width: int, bands: Bands) -> DataFrame:
    """``band, node, root, centre, n, size, linked, first``: what tells each node's set from its centre's.

    ``size`` elements are in only one of both; ``first`` has the leading ones, those that the centre lacks before those
    that only it has, the former from rare to common. ``linked``: the two sets meet the similarity.
    """
    key, often = common_shingles(texts, width)
    names = ["band", "node", "root", "centre", "n", "size", "linked", "first"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "t"):
            columns: list[list] = [[], [], [], []]
            _, which, of = np.unique(some.column("centre").to_numpy(), return_index=True, return_inverse=True)
            centre = shingles(some.column("tc").take(pa.array(which)), width)
            for u, c in zip(shingles(some.column("t"), width), (centre[i] for i in of.tolist()), strict=True):
                own, lacking = np.setdiff1d(u, c, assume_unique=True), np.setdiff1d(c, u, assume_unique=True)
                size, common = len(own) + len(lacking), len(u) - len(own)
                row = len(u), size, common * bands.den >= (common + size) * bands.num
                at = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
                if len(key):
                    own = own[np.argsort(np.where(key[at] == own, often[at], 0), kind="stable")]
                first = np.concatenate([own, lacking])[: bands.most_differing(len(u)) + 1].view(np.int64)
                for column, x in zip(columns, (*row, first), strict=True):
                    column.append(x)
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in names[:4]), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=names
            )

    left = texts.select(F.col("doc_id").alias("node"), F.col("text").alias("t"))
    right = texts.select(F.col("doc_id").alias("centre"), F.col("text").alias("tc"))
    both = nodes.join(left, "node").join(right, "centre").select("band", "node", "root", "centre", "t", "tc")
    return both.mapInArrow(work, "band int, node bigint, root bigint, centre bigint, n bigint, size bigint, linked boolean, first array<bigint>")


def kindred(found: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` pairs of one centre, not linked through it, that leave it in ways alike enough for two similar sets.

    Two sets differ in what only one of their differences from the centre has. If these have ``s`` and ``t`` elements and
    the sets may differ in ``d``, they share at least ``(s + t - d) / 2``; the first one that they share stands where so
    many are still to come in both. If ``s + t <= d``, they need share none; but then both sets are linked with the centre.
    """
    root = F.when(F.col("linked"), F.col("centre")).otherwise(F.col("root"))
    one = found.select("band", "centre", "node", root.alias("root"), "n", "size", F.posexplode("first").alias("place", "key"))
    one = one.select("band", "centre", "key", "node", "root", "n", "size", (F.col("size") - F.col("place")).alias("rest"))
    other = one.select("band", "centre", "key", *[F.col(c).alias(f"_{c}") for c in ("node", "root", "n", "size", "rest")])
    most = F.floor((F.col("n") + F.col("_n")) * (den - num) / (den + num))
    alike = 2 * F.least("rest", "_rest") >= F.col("size") + F.col("_size") - most
    close = F.least("n", "_n") * den >= F.greatest("n", "_n") * num
    return (
        one.join(other, ["band", "centre", "key"])
        .where((F.col("node") < F.col("_node")) & (F.col("root") != F.col("_root")) & alike & close)
        .select(F.col("node").alias("a"), F.col("_node").alias("b"))
        .distinct()
    )


#: Up to so many members all pairs of a bucket are compared: pairs stay in proportion to rows.
SMALL = 16
#: Shingles whose number is known when they are put in order (1.6 MB), and shingles of a task that are counted at a time.
COMMON, COUNTED = 100_000, 1 << 20


def links(docs: DataFrame, found: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``node, root`` of the representatives that have a link: the components of all verified pairs that it takes."""
    bands = Bands(num, den)
    reps = table(representatives(found), "reps")
    shared = table(shared_words(sketch_words(docs, width, bands)), "shared")
    members = shared.join(reps.select("doc_id", F.col("rep").alias("node")), "doc_id").select("key", "band", "node").distinct()
    spread = members.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi")
    buckets = table(members.join(spread.select("key"), "key"), "buckets")
    wanted = table(buckets.select(F.col("node").alias("doc_id")).distinct(), "wanted")
    texts = table(docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "doc_id", "left_semi"), "texts")
    known = table(sketches(texts, width, bands), "sketches")

    # an id that comes with several sets ties their classes together
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    linked = reps.join(least, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct()

    # each set with the representative of the bucket that it shares most words with
    head = buckets.groupBy("key").agg(F.min("node").alias("_h"))
    pairs = buckets.join(head, "key").where("node <> _h").groupBy("node", "_h").agg(F.count("*").alias("_c"), F.min("band").alias("band"))
    pairs = pairs.groupBy("node").agg(F.max_by(F.struct("_h", "band"), F.struct("_c", -F.col("_h"))).alias("_p"))
    pairs = table(pairs.select(F.col("_p._h").alias("a"), F.col("node").alias("b"), "_p.band").distinct(), "pairs")
    linked = table(linked.union(verified(near(pairs, known, num, den), texts, width, num, den)), "links")
    label = table(components(linked), "labels")

    # what is left in buckets of several components: all pairs of small ones, in large ones by differences from a centre
    named = buckets.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = named.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_size")).where("_lo < _hi")
    open_ = table(named.join(apart, "key").select("key", "band", "node", "root", (F.col("_size") > SMALL).alias("large")), "open")
    small, large = open_.where("not large"), open_.where("large")
    other = small.select("key", F.col("node").alias("_node"), F.col("root").alias("_root"))
    pairs = small.join(other, "key").where((F.col("node") < F.col("_node")) & (F.col("root") != F.col("_root")))
    pairs = table(pairs.groupBy(F.col("node").alias("a"), F.col("_node").alias("b")).agg(F.min("band").alias("band")), "pairs")
    linked = linked.union(table(verified(near(pairs, known, num, den), texts, width, num, den), "links"))
    if not large.isEmpty():
        told = table(differences(centres(large), texts, width, bands), "differences")
        linked = linked.union(told.where("linked and node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")))
        linked = linked.union(table(verified(table(kindred(told, num, den), "pairs"), texts, width, num, den), "links"))
    return table(components(linked), "labels")


def prepared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


def grouped(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, rep`` of each row.

    ``rep`` is the smallest id with the same set, ``component_id`` the smallest
    id reachable by links of similarity ``num / den`` or more.
    """
    docs = prepared(docs, doc_id, text)
    found = table(sets(docs, width), "shingle-sets")
    with small_batches(docs.sparkSession, 500):
        label = links(docs, found, width, num, den)
    reps = representatives(found).groupBy("doc_id").agg(F.min("rep").alias("rep"))
    named = reps.join(label.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        F.col("doc_id").alias("_id"), "rep", F.coalesce("root", "rep").alias("_component")
    )
    return found.join(named, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("rep")
    )


def deduplicated(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group, the one with the smallest id.

    Of rows with one id the first by text stays. Rows with a null id and texts
    without words stay.
    """
    groups = table(grouped(docs, width, num, den), "groups")
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    again = groups.where("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("_n")).where("doc_id is not null and _n > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    several = kept.join(again, "doc_id", "left_semi").withColumn("_nth", nth).where("_nth = 1").select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(several)
