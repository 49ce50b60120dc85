"""Phrases whose words come together more often than by chance, mined with stripes.

A stripe is the counter of next words of one prefix. Each task builds the stripes of its texts in
arrays, a slice of text at a time, and stripes of the same prefix are merged word by word. The
empty prefix gives the words and, as its total, the number of words of a language; a prefix of one
word gives the pairs, and so on up to ``longest``. A merged stripe has all that is asked of it: the
extensions that are frequent enough, the prefix's total, and the largest extension, by which the
prefix may be subsumed; over all prefixes of a round the extensions also give the largest one to
the left.

A phrase can only be frequent if the same phrase without its last and without its first word is.
Later rounds leave out the others, by a bit table of the frequent phrases of the round before, of
bounded size (``MOST_BITS``). Hashes only decide what is counted in vain: all counts are kept by
the words themselves, so they are exact however full the table is.

The stripe of the empty prefix and those of very frequent prefixes are dealt out in parts by their
next words, more of them the more frequent the prefix is, so no task has a whole such stripe.

Defined cases: null text is empty, null language is ``und``; repeated rows count each; texts are
read whole; an empty table has no phrases; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import slices, table
from vellum.llm.kernels import U64, span_hashes, text_bytes, window_hashes, word_hashes

#: Bytes of text whose words are counted together before they leave a task.
CHUNK = 1 << 22
#: Parts of the stripe of the empty prefix; other prefixes have a part for each so many occurrences at least,
PARTS_OF_WORDS, OCCURRENCES = 1024, 1 << 20
#: and no more parts in all than this, whatever the corpus.
MOST_PARTS = 100_000
MOST_BITS = 1 << 27
#: Ranked first within so many parts of a language.
SALTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = True
_SOLID = ~_BREAK
_SOLID[[9, 32]] = False

#: On its way a stripe is packed: its words joined by spaces, its counts as 32-bit numbers.
STRIPE = "lang string, prefix string, part int, nexts string, counts binary"
MERGED = "lang string, prefix string, total bigint, largest bigint, nexts array<string>, counts array<bigint>"


class Words:
    """The words of a slice of texts in order, as codes, with the pieces that no phrase crosses."""

    def __init__(self, text: pa.Array) -> None:
        data, offsets = text_bytes(text)
        data = _LOWER[data]
        solid = _SOLID[data]
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | border[1:-1]
        last[:-1] &= ~solid[1:] | border[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sizes = np.concatenate([[0], np.cumsum(ends - starts)])
        values = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(data[solid].tobytes()))
        encoded = values.dictionary_encode()
        self.names = encoded.dictionary.cast(pa.string())
        self.codes = encoded.indices.to_numpy().astype(np.int64)
        self.text = np.searchsorted(offsets, starts, side="right") - 1
        broken = np.cumsum(_BREAK[data], dtype=np.int64)[starts] if len(starts) else np.zeros(0, np.int64)
        self.piece = broken + self.text  # grows at each break and at each new text
        self.hashes = hashes_of(self.names)


def hashes_of(names: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(names)
    return span_hashes(data, offsets[:-1], offsets[1:], lower=False)


def _stripes(batches: Iterator[pa.RecordBatch], k: int, known: np.ndarray | None, split: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Stripes of prefixes of ``k`` words; ``known`` are the bits of frequent phrases of ``k`` words, ``split`` the parts of the most frequent."""
    for batch in slices(batches, most=CHUNK):
        words = Words(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)[words.text]
        n = len(words.codes) - k
        if n <= 0:
            continue
        at = np.arange(n)
        if k:
            hashes = window_hashes(words.hashes[words.codes], k) ^ hashes_of(langs.dictionary)[lang[: n + 1]]
            marks = hashes & U64(len(known) * 64 - 1)
            often = (known[marks >> U64(6)] >> (marks & U64(63))) & U64(1) != 0
            at = np.flatnonzero((words.piece[:n] == words.piece[k:]) & often[:-1] & often[1:])
            if not len(at):
                continue
        v, ids = len(words.names), lang[at]
        for i in range(k):  # number the prefixes
            ids = np.unique(ids * v + words.codes[at + i], return_inverse=True)[1]
        _, one, counts = np.unique(ids * v + words.codes[at + k], return_index=True, return_counts=True)
        ids, at = ids[one], at[one]
        last = words.codes[at + k]
        many = np.full(len(at), PARTS_OF_WORDS)
        if k:
            named, n_parts = split
            place = np.searchsorted(named, hashes[at])
            many = np.append(n_parts, 1)[np.where(np.append(named, U64(0))[place] == hashes[at], place, len(named))]
        parts = (words.hashes[last] >> U64(33)).astype(np.int64) % many
        order = np.lexsort((parts, ids))
        ids, at, last, parts, counts = (x[order] for x in (ids, at, last, parts, counts))
        new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (parts[1:] != parts[:-1])]))
        bounds = np.append(new, len(ids))
        heads = [words.names.take(pa.array(words.codes[at[new] + i])) for i in range(k)]
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(counts.astype("<i4"))])
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(lang[at[new]])),
                pc.binary_join_element_wise(*heads, " ") if k else pa.array([""] * len(new), pa.string()),
                pa.array(parts[new].astype(np.int32)),
                pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.names.take(pa.array(last))), " "),
                packed,
            ],
            names=["lang", "prefix", "part", "nexts", "counts"],
        )


def _unpacked(batch: pa.RecordBatch) -> pa.Table:
    nexts = pc.split_pattern(batch.column("nexts"), " ")
    counts = batch.column("counts")
    places = np.frombuffer(counts.buffers()[1], np.int32)[counts.offset : counts.offset + len(counts) + 1]
    flat = np.frombuffer(counts.buffers()[2], "<i4")[places[0] // 4 : places[-1] // 4].astype(np.int64)
    lists = [nexts, pa.ListArray.from_arrays(pa.array((places - places[0]) // 4, pa.int32()), pa.array(flat))]
    return pa.table([*(batch.column(c) for c in ("lang", "prefix", "part")), *lists], names=["lang", "prefix", "part", "nexts", "counts"])


def _added(rows: pa.Table) -> pa.Table:
    """One stripe for each ``lang, prefix, part``, counts added up word by word."""
    keys = ["lang", "prefix", "part"]
    rows = rows.combine_chunks()
    ids = rows.select(keys).append_column("row", pa.array(np.arange(len(rows)))).group_by(keys).aggregate([("row", "min")])
    starts = np.sort(ids.column("row_min").to_numpy())  # equal keys are adjacent
    nexts, counts = (rows.column(c).combine_chunks() for c in ("nexts", "counts"))
    nexts, counts = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (nexts, counts))
    sizes = nexts.value_lengths().to_numpy()
    stripe = np.repeat(np.searchsorted(starts, np.arange(len(rows)), side="right") - 1, sizes)
    flat = pa.table({"stripe": stripe, "next": nexts.flatten(), "n": counts.flatten()}).group_by(["stripe", "next"]).aggregate([("n", "sum")])
    order = np.argsort(flat.column("stripe").to_numpy(), kind="stable")
    flat = flat.take(pa.array(order)).combine_chunks()
    bounds = np.searchsorted(flat.column("stripe").to_numpy(), np.arange(len(starts) + 1))
    one = lambda c: pa.concat_arrays(flat.column(c).chunks)
    lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), one(c)) for c in ("next", "n_sum")]
    return rows.select(keys).take(pa.array(starts)).append_column("nexts", lists[0]).append_column("counts", lists[1])


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Merge sorted stripes; the stripe that a batch ends with is kept, merged, for the next."""

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        counts, nexts = (pa.concat_arrays(rows.column(c).chunks) for c in ("counts", "nexts"))
        flat, sizes = counts.flatten().to_numpy(), counts.value_lengths().to_numpy()
        starts = np.cumsum(sizes) - sizes
        keep = flat >= least
        kept = np.add.reduceat(keep.astype(np.int64), starts)
        bounds = pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, x.flatten().filter(pa.array(keep))) for x in (nexts, counts)]
        numbers = [pa.array(f.reduceat(flat, starts)) for f in (np.add, np.maximum)]
        columns = [*(pa.concat_arrays(rows.column(c).chunks) for c in ("lang", "prefix")), *numbers, *lists]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "total", "largest", "nexts", "counts"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        some = _unpacked(batch)
        some = _added(pa.concat_tables([held, some]) if held is not None else some)
        held = some.slice(len(some) - 1)
        if len(some) > 1:
            yield from out(some.slice(0, len(some) - 1).combine_chunks())
    if held is not None:
        yield from out(held.combine_chunks())


def stripes(docs: DataFrame, k: int, least: int, known: np.ndarray | None, split: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Merged stripes of all prefixes of ``k`` words: see ``MERGED``; of next words those with ``least`` are kept.

    ``total`` and ``largest`` are those of all next words that were counted, in one part of a stripe.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, split))
    built = docs.mapInArrow(lambda batches: _stripes(batches, k, *shared.value), STRIPE)
    keys = ["lang", "prefix", "part"]
    dealt = built.repartition(*keys).sortWithinPartitions(*keys)
    merged = table(dealt.mapInArrow(lambda batches: _merge(batches, least), MERGED), f"stripes-{k}")
    shared.destroy()
    return merged


def bits_of(phrases: DataFrame, k: int, n: int, most: int = MOST_BITS) -> np.ndarray:
    """A table of at most ``most`` bits, with the bit of each phrase of ``k`` words set; some 16 bits a phrase below that."""
    size = max(1 << 12, min(most, 1 << (16 * n).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, _ in _hashed(batches, k):
            marks = hashes & U64(size - 1)
            yield pa.RecordBatch.from_arrays([pa.array((marks >> U64(6)).astype(np.int64)), pa.array((U64(1) << (marks & U64(63))).view(np.int64))], names=["place", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(places, "place bigint, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _hashed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        if batch.num_rows:
            hashes, bounds = word_hashes(batch.column("phrase"), lower=False)
            yield window_hashes(hashes, k)[bounds[:-1]] ^ hashes_of(batch.column("lang")), batch


def parts_of(phrases: DataFrame, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the phrases of ``k`` words that are very frequent among ``n`` words, and their numbers of parts; fewer than ``MOST_PARTS``."""
    unit = max(OCCURRENCES, -(-n // MOST_PARTS))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, batch in _hashed(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pc.add(pc.divide(batch.column("a"), unit), 1)], names=["hash", "parts"])

    found = phrases.where(F.col("a") >= unit).select("lang", "phrase", "a").mapInArrow(hashed, "hash bigint, parts bigint").toArrow()
    hashes = found.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found.column("parts").to_numpy()[order]


def counted(docs: DataFrame, least: int = 100, longest: int = 5, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Frequent phrases ``lang, phrase, n_words, a, largest`` up to ``longest`` words, and ``lang, n``.

    ``largest`` is the count of the most frequent phrase that has one word more, at either end, if that is frequent.
    """
    some = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = split = phrases = totals = None
    for k in range(longest):
        merged = stripes(some, k, least, known, split)
        if k == 0:
            totals = merged.groupBy("lang").agg(F.sum("total").alias("n"))
            n_all = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        pairs = F.arrays_zip(F.col("nexts").alias("w"), F.col("counts").alias("a"))
        phrase = F.col("p.w") if k == 0 else F.concat_ws(" ", "prefix", "p.w")
        found = merged.select("lang", "prefix", F.explode(pairs).alias("p")).select("lang", phrase.alias("phrase"), F.lit(k + 1).alias("n_words"), F.col("p.a").alias("a"))
        phrases = found if phrases is None else phrases.unionByName(found)
        if k >= 2:  # a stripe has its prefix's largest extension; a phrase without its first word is extended to the left
            right = merged.where(F.col("largest") >= least).select("lang", F.col("prefix").alias("phrase"), "largest")
            left = found.select("lang", F.substring_index("phrase", " ", -k).alias("phrase"), F.col("a").alias("largest"))
            longer = right.unionByName(left) if k == 2 else longer.unionByName(right).unionByName(left)
        n = found.count()
        if not n:
            break
        if k + 1 < longest:
            known, split = bits_of(found, k + 1, n), parts_of(found, k + 1, n_all)
    if k >= 2:
        phrases = phrases.join(longer.groupBy("lang", "phrase").agg(F.max("largest").alias("largest")), ["lang", "phrase"], "left")
    else:
        phrases = phrases.withColumn("largest", F.lit(None).cast("bigint"))
    return table(phrases, "phrases"), totals


def mined(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, **columns: str) -> DataFrame:
    """The ``first`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``score`` is how many thousandths of the count by chance the count ``a`` is, for the cut into two parts
    (counted ``l`` and ``r``) for which that is least. A phrase within a longer one as frequent is left out.
    """
    phrases, totals = counted(docs, least, longest, **columns)
    own = phrases.where((F.col("n_words") > 1) & (F.col("largest").isNull() | (F.col("largest") < F.col("a"))))
    cut = own.select("lang", "phrase", "a", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("cut"))
    sides = F.expr("array(substring_index(phrase, ' ', cut), substring_index(phrase, ' ', cut - n_words))")
    cut = cut.select("lang", "phrase", "a", "cut", F.posexplode(sides).alias("side", "_part"))
    counts = phrases.where(F.col("n_words") < longest).select("lang", F.col("phrase").alias("_part"), F.col("a").alias("f"))
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("f")))
    cut = cut.join(counts, ["lang", "_part"]).groupBy("lang", "phrase", "a", "cut").agg(side(0).alias("l"), side(1).alias("r"))
    exact = lambda c: f"cast({c} as decimal(18, 0))"
    scored = cut.join(totals, "lang").withColumn("score", F.expr(f"cast(1000 as decimal(4, 0)) * {exact('a')} * {exact('n')} div ({exact('l')} * {exact('r')})"))
    best = F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "cut"))
    scored = scored.groupBy("lang", "phrase", "a").agg(best.alias("best")).select("lang", "phrase", "a", "best.*")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salted = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SALTS))).orderBy(*order)
    few = scored.withColumn("_rank", F.row_number().over(salted)).where(F.col("_rank") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
