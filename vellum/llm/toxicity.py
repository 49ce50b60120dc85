"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Two models, of toxic and of ordinary texts, are counted from labelled rows, in
continuation counts: after how many words a pair of words occurs, and after how
many words a word does. So a passage that is copied a thousand times counts as
one. The classes share what they back off to. A pair gives up a
discount in each class and, with ``PRIOR`` pseudo-counts, leans on the word's
continuation counts; the word in turn leans on the classes' shares of all
continuations. By Bayes' rule the
probability of a word in class k is

    P_k(w | v) = P(w | v) * q_k(v w) / t_k
    q_k(v w) = (max(c_k(v w) - D, 0) + (D * classes(v w) + PRIOR) * b_k(w)) / (c(v w) + PRIOR)
    q_k(w)   = (max(n_k(w) - D, 0) + (D * classes(w) + PRIOR) * s_k(w)) / (n(w) + PRIOR)

with c the continuation counts of pairs, n those of words, t_k and s_k the class's shares
of those among expressions that are about as common (a smaller class sees more
new neighbours for each use of a common word), ``classes`` the number of classes
that have the expression, and b_k(w) proportional to t_k * q_k(w) / s_k(w). The
first factor, the shared model, is the same in both classes and divides out of
the comparison. A rare expression is thus judged by the shared counts and tells
little either way, however much smaller one class is.

Where the classes differ by less than a factor of e all the same, the pair is
pruned and the shared model stands for both: on long texts the chance differences
of many ordinary words would else outweigh the few that matter.

A text's score compares the two log-likelihoods, normalised for its length; a
logistic curve over the difference per square root of the words (the unit in which
chance differences do not grow with the length) turns it into 0 to 1. The curve is fitted with each text taken out of the counts
before it is judged.

Counts come from all labelled rows that may be learnt from. They are a Spark table
with one row for each word and each pair, keyed by whole codes (32 bits a word, 64 a
pair), which grows with the input; a pair's row also has its word's counts. A pair seen
after one word only has no row and is judged like one never seen.

Nothing that grows with the corpus passes through the driver. What pruning leaves is a
Spark table too: the log-ratio of each word, and of each pair what it adds to its word's.
The most common of these (whole levels of commonness, at most ``HEAD`` expressions) are
broadcast and added up where the documents are. For the others documents send the words and pairs
that a bit table of bounded size lets through (a full table only lets more through) to a
join, once for each different text, and the sums come back by the text's digest. The curve
is fitted on at most ``fit_rows`` labelled rows, taken by hash of the id; in slices they meet
the counts of what they hold, and only a number and a label of each come to the driver.
Sums are of whole numbers, so reruns agree to the last bit.

Defined cases: a null text is an empty one; an empty text scores as one without
any evidence; an id with several labels is toxic if one of them is; labels that
are null are left out; without labels of both kinds no text is toxic (score 0);
repeated rows score alike; a null id is scored and never learnt from; an empty
table gives no rows; clashing columns of the input are replaced by the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import replaced, slices, table
from vellum.llm.kernels import mix, span_hashes, text_bytes, word_spans

U64 = np.uint64
DISCOUNT = 0.75
PRIOR = 30.0
#: Log-ratio up to which an expression is left to the shared model.
PRUNE = 1.0
#: Normalised differences beyond this say no more.
FAR = 2.0
FIT_ROWS = 20_000
#: Parts of the fitted rows; a task holds one.
FIT_SLICES = 128
#: Log-ratios are added up in units of this part of one.
UNIT = 1 << 24
#: Expressions whose log-ratios are broadcast, at most (20 MB).
HEAD = 1_000_000
#: Size of the bit table of the others, at most (16 MB).
MOST_BITS = 1 << 27
#: Copies of a hot expression's or a hot text's row, so that its partners meet it in many tasks.
SALTS = 16
#: Labels up to this number are broadcast to the documents (a few MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
PARTS = "word int, before int, kind int, c0 int, c1 int"
COUNTS = "kind int, code bigint, c0 int, c1 int, n0 int, n1 int"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(True))


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit code of each word, lower-cased and without punctuation around it, and the words before each text."""
    data, offsets = text_bytes(column)
    starts, ends, bounds = word_spans(data, offsets)
    for _ in range(3):
        trim = _PUNCTUATION[data[ends - 1]] & (ends - starts > 1)
        ends = ends - trim
        trim = _PUNCTUATION[data[starts]] & (ends - starts > 1)
        starts = starts + trim
    return span_hashes(data, starts, ends) >> U64(32), bounds


def pairs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each word with the one before it (0 at the start of a text) as one 64-bit number."""
    before = np.zeros(len(codes), np.uint64)
    before[1:] = codes[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[first] = 0
    return (before << U64(32)) | codes


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct runs of three words ``u, v, w`` by class: ``pair`` is v and w, ``tail`` 28 bits of u and the class.

    They are merged over a few million words of a task.
    """
    kept: list[tuple] = []

    def flush() -> pa.RecordBatch:
        before, pair, toxic = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        tail = (((before & U64((1 << 28) - 1)) << U64(1)) | toxic.astype(np.uint64)).astype(np.int32)
        _, first = np.unique(mix(pair + mix(tail.astype(np.uint64))), return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(pair[first].view(np.int64)), pa.array(tail[first])], names=["pair", "tail"])

    held = 0
    for some in slices(batches):
        codes, bounds = word_codes(some.column("text"))
        pair = pairs(codes, bounds)
        toxic = np.repeat(some.column("toxic").to_numpy(zero_copy_only=False) == 1, np.diff(bounds))
        kept.append((pairs(pair >> U64(32), bounds) >> U64(32), pair, toxic))
        held += len(pair)
        if held > 1_500_000:
            yield flush()
            held = 0
    if held:
        yield flush()


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come sorted by a key, cut so that rows of one key stay together."""
    held: list[list[np.ndarray]] = []
    joined = lambda: [np.concatenate(x) for x in zip(*held, strict=True)]
    for some in batches:
        if some.num_rows == 0:
            continue
        at = some.schema.names.index(key)
        columns = [x.to_numpy() for x in some.columns]
        last = columns[at][-1]
        if held and held[0][at][-1] == last:  # the whole batch is of the key that is held
            held.append(columns)
            continue
        cut = int(np.searchsorted(columns[at], last))  # the last key may go on
        held.append([x[:cut] for x in columns])
        if whole := joined():
            if len(whole[0]):
                yield whole
        held = [[x[cut:] for x in columns]]
    if held:
        yield joined()


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (0: pairs after two words or more, 1: words, to be added up) from triples that come sorted."""

    def out(kind: int, word: np.ndarray, before: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
        columns = [word.astype(np.uint32).view(np.int32), before.astype(np.uint32).view(np.int32), np.full(len(word), kind, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in [*columns, *(c.astype(np.int32) for c in counts)]], names=["word", "before", "kind", "c0", "c1"])

    for pair, tail in _runs(batches, "pair"):
        new = np.append(True, (pair[1:] != pair[:-1]) | (tail[1:] != tail[:-1]))
        pair, toxic = pair[new], tail[new] & 1
        start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        c1 = np.add.reduceat(toxic, start)
        c0 = np.diff(np.append(start, len(pair))) - c1
        pair, often = pair[start].view(np.uint64), c0 + c1 > 1
        word, before = pair & U64(0xFFFFFFFF), pair >> U64(32)
        if often.any():
            yield out(0, word[often], before[often], [c0[often], c1[often]])
        at, which = np.unique(word, return_inverse=True)
        yield out(1, at, np.zeros(len(at)), [np.bincount(which, x > 0, len(at)) for x in (c0, c1)])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each word and pair, with the counts of its word, from rows of ``PARTS`` that come sorted by word."""
    for word, before, kind, c0, c1 in _runs(batches, "word"):
        at, which = np.unique(word, return_inverse=True)
        n = [np.bincount(which, c * (kind == 1), len(at)).astype(np.int32) for c in (c0, c1)]
        pair = kind == 0
        low, high = (x.view(np.uint32).astype(np.uint64) for x in (word[pair], before[pair]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([0, 1], np.int32), [len(low), len(at)])),
                pa.array(np.concatenate([(high << U64(32)) | low, at.view(np.uint32).astype(np.uint64)]).view(np.int64)),
                *[pa.array(np.concatenate([c[pair], m])) for c, m in zip((c0, c1), n, strict=True)],
                *[pa.array(np.concatenate([m[which[pair]], m])) for m in n],
            ],
            names=["kind", "code", "c0", "c1", "n0", "n1"],
        )


def _share(own: list[np.ndarray], backoff: np.ndarray) -> np.ndarray:
    """Share of each class in an expression: discounted counts, and what they give up spread by the shares behind."""
    freed = PRIOR + DISCOUNT * ((own[0] > 0) * 1.0 + (own[1] > 0))
    every = own[0] + own[1] + PRIOR
    return np.stack([(np.maximum(own[k] - DISCOUNT, 0) + freed * backoff[k]) / every for k in (0, 1)])


def _level(n: np.ndarray) -> np.ndarray:
    return np.log2(n + 1).astype(np.int64)


class Table:
    """Values by code: sorted, so that it takes as much room as there are codes."""

    def __init__(self, code: np.ndarray, values: list[np.ndarray]) -> None:
        order = np.argsort(code)
        self.code, self.values = code[order], [x[order] for x in values]

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each code is, and whether it is there at all."""
        code = code.view(np.int64)
        if len(self.code) == 0:
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return at, self.code[at] == code

    def get(self, code: np.ndarray) -> list[np.ndarray]:
        """The values of each code, 0 where there are none."""
        at, there = self.find(code)
        return [np.where(there, x[at] if len(x) else 0, 0).astype(float) for x in self.values]

    def exact(self, code: np.ndarray) -> np.ndarray:
        """The first value of each code as a whole number, 0 where there is none."""
        at, there = self.find(code)
        return np.where(there, self.values[0][at], 0) if len(self.code) else np.zeros(len(code), np.int64)


def class_shares(sums: np.ndarray) -> np.ndarray:
    """Shares of the classes among expressions of each level of commonness, from their counts by class and level."""
    sums = sums + 1e-6
    every = sums.sum(axis=1, keepdims=True) + 1.0
    sums += 100 * every / every.sum()  # levels with few counts lean on the rest
    return sums / sums.sum(axis=0)


def log_ratios(c: list[np.ndarray], n: list[np.ndarray], shares: list[np.ndarray]) -> np.ndarray:
    """Log of toxic over ordinary probability from the counts of pairs and of their words, pruned."""
    t, s = (x[:, _level(m[0] + m[1])] for x, m in zip(shares, (c, n), strict=True))
    behind = t * _share(n, s) / s
    q = _share(c, behind / behind.sum(axis=0))
    ratio = np.log(q[1] / t[1]) - np.log(q[0] / t[0])
    return np.where(np.abs(ratio) > PRUNE, ratio, 0.0)


def features(ratios: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text: difference of the log-likelihoods per square root of the words, within bounds, and 1; ``ratios`` are in units."""
    sums = np.concatenate([[0], np.cumsum(ratios)]) if len(ratios) else np.zeros(1)
    total, size = sums[bounds[1:]] - sums[bounds[:-1]], np.maximum(np.diff(bounds), 1)
    return np.stack([np.clip(total / UNIT / np.sqrt(size), -FAR, FAR), np.ones(len(size))], axis=1)


@dataclass
class Counted:
    """Counts of the pairs and words of some texts, to judge each of these texts without its own."""

    pair: Table
    word: Table
    shares: list[np.ndarray]

    def ratios(self, codes: np.ndarray, bounds: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log-ratio of each word; ``own`` is the class of each text, whose counts are taken out of that class."""
        both = pairs(codes, bounds)
        n, c = self.word.get(codes), self.pair.get(both)
        self._without(own, bounds, both, codes, c, n)
        return log_ratios(c, n, self.shares)

    @staticmethod
    def _without(own, bounds, place, word, c, n) -> None:
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if a == b:
                continue
            k, here = int(own[i]), slice(a, b)
            _, at, times = np.unique(place[here], return_inverse=True, return_counts=True)
            only = c[k][here] <= times[at]  # the class knows the pair from this text alone
            _, which = np.unique(word[here], return_inverse=True)
            lone = only / times[at]  # each such pair counts once in all
            n[k][here] = np.maximum(n[k][here] - np.round(np.bincount(which, lone)[which], 6), 0)
            c[k][here] = np.maximum(c[k][here] - times[at], 0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Fitted:
    """``kind, code, value, level`` of all expressions that say something (none without both classes), and the curve."""

    said: DataFrame | None
    weights: np.ndarray


def _learnable(labels: DataFrame) -> DataFrame:
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    return known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def counts_of(texts: DataFrame) -> DataFrame:
    """Rows of ``COUNTS``, one for each word and pair of ``text, toxic`` rows: kind 0 are pairs, 1 words."""
    return (
        texts.select("text", "toxic")
        .mapInArrow(_triples, "pair bigint, tail int")
        .repartition("pair")
        .sortWithinPartitions("pair", "tail")
        .mapInArrow(_statistics, PARTS)
        .repartition("word")
        .sortWithinPartitions("word")
        .mapInArrow(_merged, COUNTS)
    )


def _said(counts: DataFrame, shares: list[np.ndarray]) -> DataFrame:
    """``kind, code, value, level``: the log-ratio of each word, and what that of each pair adds to its word's; those that are not 0.

    ``level`` is higher the more common an expression is, eight levels for each doubling.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            kind, code, *numbers = (x.to_numpy() for x in some.columns)
            c, n = [x.astype(float) for x in numbers[:2]], [x.astype(float) for x in numbers[2:]]
            word = log_ratios([x * 0 for x in n], n, shares)
            value = in_units(np.where(kind == 0, log_ratios(c, n, shares), word)) - np.where(kind == 0, in_units(word), 0)
            keep = value != 0
            level = (8 * np.log2(c[0] + c[1] + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (kind, code, value, level)], names=["kind", "code", "value", "level"])

    return counts.mapInArrow(work, "kind int, code bigint, value bigint, level int")


def in_units(ratios: np.ndarray) -> np.ndarray:
    return np.round(ratios * UNIT).astype(np.int64)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``slice, kind, code`` of the texts' words and pairs, each once in a piece of a slice."""
    for some in slices(batches):
        codes, bounds = word_codes(some.column("text"))
        part = np.repeat(some.column("slice").to_numpy().astype(np.int32), np.diff(bounds))
        both = pairs(codes, bounds)
        for k in np.unique(part).tolist():
            found = [np.unique(x[part == k]) for x in (both, codes)]
            kind = np.repeat(np.array([0, 1], np.int32), [len(x) for x in found])
            names = ["slice", "kind", "code"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kind), k, np.int32)), pa.array(kind), pa.array(np.concatenate(found).view(np.int64))], names=names)


def _curve(chosen: DataFrame, counts: DataFrame, shares: list[np.ndarray]) -> np.ndarray | None:
    """Weights of the curve over ``doc_id, text, toxic`` rows; None if all have the same label."""
    rows = chosen.select(F.pmod(F.xxhash64("doc_id"), F.lit(FIT_SLICES)).cast("int").alias("slice"), "text", "toxic")
    within = rows.select("slice", "text").mapInArrow(_codes, "slice int, kind int, code bigint").distinct()
    known = counts.select("kind", "code", "c0", "c1").join(within, ["kind", "code"]).select("slice", "kind", "code", "c0", "c1")

    def judged(texts: pa.Table, numbers: pa.Table) -> pa.Table:
        kind, code = numbers.column("kind").to_numpy(), numbers.column("code").to_numpy()
        counted = Counted(*(Table(code[kind == k], [numbers.column(c).to_numpy()[kind == k] for c in ("c0", "c1")]) for k in (0, 1)), shares)
        found = [np.zeros(0)]
        for some in slices(texts.to_batches()):
            codes, bounds = word_codes(some.column("text"))
            ratios = in_units(counted.ratios(codes, bounds, some.column("toxic").to_numpy(zero_copy_only=False)))
            found.append(features(ratios, bounds)[:, 0])
        return pa.table({"x": pa.array(np.concatenate(found)), "toxic": texts.column("toxic")})

    got = rows.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(judged, "x double, toxic int").toArrow()  # at most the rows fitted
    x, toxic = (got.column(c).to_numpy() for c in ("x", "toxic"))
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return None
    order = np.lexsort((toxic, x))  # the same sums in every run
    return logistic(np.stack([x, np.ones(len(x))], axis=1)[order], toxic[order])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Fitted:
    """Count both models over all learnable rows and fit the curve."""
    known = _learnable(labels.select("doc_id", "toxic"))
    texts = docs.select("doc_id", "text").where(~held_out())
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known.hint("shuffle_hash")
    counts = table(counts_of(texts.join(side, "doc_id")), "toxicity-counts")
    level = (F.length(F.bin(F.col("c0").cast("bigint") + F.col("c1") + 1)) - 1).alias("level")
    sums = np.zeros((2, 2, 64))
    for r in counts.groupBy("kind", level).agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).collect():
        sums[r["kind"], :, r["level"]] = r["c0"], r["c1"]
    if sums[1].sum(axis=1).min() == 0:
        return Fitted(None, np.zeros(2))
    shares = [class_shares(x) for x in sums]
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    weights = _curve(texts.join(F.broadcast(sample), "doc_id"), counts, shares)
    if weights is None:
        return Fitted(None, np.zeros(2))
    return Fitted(table(_said(counts, shares), "toxicity-ratios"), weights)


def _marks(kind: np.ndarray | int, code: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each expression in a table of so many."""
    return mix(code.view(np.uint64) * U64(2) + np.asarray(kind).astype(np.uint64)) & U64(bits - 1)


def bits_of(said: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """A table of at most ``most`` bits, with the bit of each expression set; some 64 bits an expression below that."""
    bits = max(1 << 12, min(most, 1 << (64 * said.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            marks = _marks(some.column("kind").to_numpy(), some.column("code").to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((marks >> U64(6)).astype(np.int64)), pa.array((U64(1) << (marks & U64(63))).view(np.int64))], names=["place", "bits"])

    found = said.select("kind", "code").mapInArrow(places, "place bigint, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _uses(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``digest, kind, code, times`` of the words and pairs of each text that may say something."""
    for some in slices(batches):
        codes, bounds = word_codes(some.column("text"))
        size = np.diff(bounds)
        text = np.repeat(np.arange(len(size)), size)
        for kind, every in ((0, pairs(codes, bounds)), (1, codes)):
            marks = _marks(kind, every, len(bits) * 64)
            may = (bits[marks >> U64(6)] >> (marks & U64(63))) & U64(1) == 1
            of, code = text[may], every[may]
            order = np.lexsort((code, of))
            of, code = of[order], code[order]
            first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (code[1:] != code[:-1]))) if len(of) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(of)))
            of, code = of[first], code[first]
            yield pa.RecordBatch.from_arrays(
                [some.column("digest").take(pa.array(of)), pa.array(np.full(len(of), kind, np.int32)), pa.array(code.view(np.int64)), pa.array(times.astype(np.int64))],
                names=["digest", "kind", "code", "times"],
            )


def tail_sums(docs: DataFrame, tail: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """``digest, sum`` of the log-ratios of these expressions in each different text that has one."""
    shared = docs.sparkSession.sparkContext.broadcast(bits_of(tail, most))
    uses = docs.select(_digest().alias("digest"), "text").mapInArrow(lambda b: _uses(b, shared.value), "digest binary, kind int, code bigint, times bigint")
    # copies of a text say the same: one of them counts
    uses = uses.groupBy("digest", "kind", "code").agg(F.max("times").alias("times"))
    uses = uses.withColumn("salt", F.pmod(F.hash("digest"), F.lit(SALTS)))
    salted = tail.select("kind", "code", "value").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sums = uses.join(salted, ["kind", "code", "salt"]).groupBy("digest").agg(F.sum(F.col("times") * F.col("value")).alias("sum"))
    found = table(sums, "toxicity-tail")
    shared.destroy()
    return found


def parted(said: DataFrame, most: int = HEAD) -> tuple[list[Table], DataFrame | None]:
    """The values of the pairs and words of the highest levels, at most so many, and the table of the others if there are any."""
    levels = sorted(((r["level"], r["count"]) for r in said.groupBy("level").count().collect()), reverse=True)
    total, least = 0, None
    for level, n in levels:
        if total + n > most:
            break
        total, least = total + n, level
    rest = total < sum(n for _, n in levels)
    rows = said.where(F.lit(False) if least is None else F.col("level") >= least).select("kind", "code", "value").toArrow()
    kind, code, value = (rows.column(c).to_numpy() for c in ("kind", "code", "value"))
    head = [Table(code[kind == k], [value[kind == k]]) for k in (0, 1)]
    return head, (said if least is None else said.where(F.col("level") < least)) if rest else None


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def scored(docs: DataFrame, fitted: Fitted, head: int = HEAD, bits: int = MOST_BITS) -> DataFrame:
    """All columns of the documents, and ``score`` (0 to 1) and ``predicted`` (1 if 0.5 or more)."""
    docs = replaced(docs, ["score", "predicted"])
    if fitted.said is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    common, tail = parted(fitted.said, head)
    held = docs.sparkSession.sparkContext.broadcast(common)
    own = ["_toxicity_sum", "_toxicity_size", "_toxicity_text", "_toxicity_salt"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            codes, bounds = word_codes(some.column("text"))
            ratios = sum(t.exact(c) for t, c in zip(held.value, (pairs(codes, bounds), codes), strict=True))
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(ratios)])
            columns = [pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(np.diff(bounds).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*some.columns, *columns], names=[*some.schema.names, *own[:2]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.mapInArrow(work, f"{fields}, {own[0]} bigint, {own[1]} bigint")
    total = F.col(own[0])
    if tail is not None:
        found = tail_sums(docs, tail, bits).withColumnsRenamed({"digest": own[2], "sum": "_toxicity_tail"})
        found = found.withColumn(own[3], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn(own[2], _digest()).withColumn(own[3], F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(found, own[2:], "left")
        total = total + F.coalesce("_toxicity_tail", F.lit(0))
    x = total / F.lit(UNIT) / F.sqrt(F.greatest(F.col(own[1]), F.lit(1)))
    slope, base = (float(w) for w in fitted.weights)
    z = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), x)) * slope + base
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    out = out.withColumn("score", score).drop(*own, "_toxicity_tail")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the learnable labels and score every document; ``held_out`` tells the rows not learnt from."""
    docs = replaced(docs, ["score", "predicted", "held_out"])
    return scored(docs, fit(docs, labels)).withColumn("held_out", held_out())
