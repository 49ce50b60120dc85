"""Quality classifier from weak labels.

Several heuristic labellers look at a text; each calls it good, calls it bad or
abstains, and none is right always. Expectation-maximisation estimates, without
any labelled text, how often each labeller says what on good and on bad texts,
and from that the chance that a text is good given all votes. These posterior
labels train a linear scorer on hashed features: the words of the text and the
shapes of its words. The scorer also judges texts on which the labellers abstain.

The votes of all texts are counted by pattern (at most ``3**8`` patterns), so the
estimation sees the whole table and little of it reaches the driver. The scorer
is trained on at most ``FIT_ROWS`` texts, taken by hash of the id and text.

Defined cases: a null or empty text has no evidence and scores as the share of
good texts; repeated rows score alike; an empty table gives no rows; clashing
columns of the input are replaced by the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import replaced, slices
from vellum.llm.kernels import mix, span_hashes, text_bytes, window_hashes, word_spans

U64 = np.uint64
BITS = 16
SHAPES = 1 << 9
FIT_ROWS = 20_000
PASSES = 12

_KIND = np.zeros((4, 256), np.int64)  # upper-case letter, any letter, symbol, end of a sentence
_KIND[0, 65:91] = 1
_KIND[1, [b for b in range(256) if b >= 128 or chr(b).isalpha()]] = 1
_KIND[2, list(b"#*$%&|<>!")] = 1
_KIND[3, list(b".?;:")] = 1
# In UTF-8 the capitals of the Latin-1 letters are C3 80 to C3 9E.


class Words:
    """Word-wise measures of a column of texts."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = text_bytes(column)
        starts, ends, self.bounds = word_spans(data, offsets)
        self.hashes = span_hashes(data, starts, ends)
        high = np.zeros(len(data), np.int64)
        if len(data) > 1:
            high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        letters = (data & 0xC0) != 0x80  # the first byte of each character

        def inside(x: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(x)])
            return total[ends] - total[starts]

        self.size = inside(letters.astype(np.int64))
        self.upper = inside(_KIND[0][data] + high)
        self.letters = inside(_KIND[1][data] * letters)
        self.symbols = inside(_KIND[2][data])
        last = data[ends - 1]
        first = _KIND[0][data[starts]] + (high[np.minimum(starts + 1, len(data) - 1)] if len(data) else high[starts])
        self.count = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        before = np.zeros(len(starts), bool)
        before[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.text[1:] == self.text[:-1])
        self.again = before
        self.known = self._seen()
        shape = np.where(self.letters == 0, 3, np.where((self.upper > 1) & (self.upper == self.letters), 2, np.minimum(first, 1)))
        end = np.where(_KIND[3][last] > 0, 1, np.where(last == 44, 2, np.where(_KIND[2][last] > 0, 3, 0)))
        size = np.minimum(np.log2(np.maximum(self.size, 1) * 2 - 1).astype(np.int64), 7)
        self.shape = (((size * 4 + shape) * 4 + end) * 2 + self.again) * 2 + self.known
        self.capital, self.ending = shape == 2, end == 1

    def _seen(self) -> np.ndarray:
        """Words that end a run of three which the text has had before."""
        n = len(self.hashes)
        seen = np.zeros(n, bool)
        if n >= 3:
            runs = mix(window_hashes(self.hashes, 3) + self.text[2:].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
            _, first = np.unique(runs, return_index=True)
            again = np.ones(len(runs), bool)
            again[first] = False
            seen[2:] = again & (self.text[2:] == self.text[:-2])
        return seen

    def share(self, x: np.ndarray) -> np.ndarray:
        """Mean of a word-wise measure in each text; 0 where there is no word."""
        return np.bincount(self.text, x, len(self.count)) / np.maximum(self.count, 1)

    def distinct(self) -> np.ndarray:
        """Distinct words over the square root of twice the words, which hardly depends on the length."""
        pairs = np.unique(mix(self.hashes + self.text.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
        return np.bincount(self.text[pairs], minlength=len(self.count)) / np.sqrt(np.maximum(2 * self.count, 1))


def _vote(good: np.ndarray, bad: np.ndarray, may: np.ndarray) -> np.ndarray:
    return np.where(may & bad, 2, np.where(may & good, 1, 0))


def votes(w: Words) -> np.ndarray:
    """One column per labeller: 0 abstains, 1 good, 2 bad."""
    n = w.count
    some, many = n >= 10, n >= 30
    known, again, symbols = w.share(w.known), w.share(w.again), w.share(w.symbols)
    capitals, short, ends = w.share(w.capital), w.share(w.size <= 3), w.share(w.ending)
    mean, rich = w.share(w.size), w.distinct()
    return np.stack(
        [
            _vote(known < 0.1, known > 0.4, some),  # runs of words come again
            _vote(again < 0.05, again > 0.25, some),  # a word follows itself
            _vote(symbols < 0.1, symbols > 0.3, some),
            _vote(capitals < 0.1, capitals > 0.5, some),
            _vote((short > 0.15) & (short < 0.8), short < 0.03, many),  # function words
            _vote((ends > 0.02) & (ends < 0.5), ends < 0.004, many),  # sentences
            _vote(rich > 3.0, rich < 1.5, many),
            _vote((mean > 3) & (mean < 10), (mean < 2) | (mean > 15), many),
        ],
        axis=1,
    )


LABELLERS = 8
#: Bounds of a labeller's bad votes on bad and on good texts: both sides of an even chance for the second, so that a labeller may turn out to be noise.
BAD_VOTES = ((0.05, 0.9), (1e-4, 0.5))
#: Labellers are believed to be right on good texts: so many texts more, per good one, on which each says good.
BELIEF = 0.25
_BASE = 3 ** np.arange(LABELLERS)


class LabelModel:
    """Chances of each vote on bad and good texts, and the chance of a good text, from counts of vote patterns.

    Labellers whose bad votes go with those of others are estimated to be right,
    one whose bad votes come alike with and without the others' to be noise.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> None:
        self.prior = 0.8
        says = (patterns[:, None] // _BASE) % 3  # pattern x labeller
        self.chance = np.full((2, LABELLERS, 3), 1 / 2)
        if not counts.sum():
            return
        voted = [((says == vote) * counts[:, None]).sum(0) for vote in (1, 2)]
        self._bounded(0.3, voted[1] / np.maximum(voted[0] + voted[1], 1) / 2)
        good = self._posterior(patterns, 0)
        for _ in range(rounds):
            bad_votes = []
            for side in (1 - good, good):
                n = [((says == vote) * (side * counts)[:, None]).sum(0) + 1.0 for vote in (1, 2)]
                if side is good:
                    n[0] = n[0] + BELIEF * (good * counts).sum()
                bad_votes.append(n[1] / (n[0] + n[1]))
            self._bounded(*bad_votes)
            self.prior = float(np.clip((good * counts).sum() / counts.sum(), 0.5, 0.98))
            new = self._posterior(patterns, 0)
            if np.abs(new - good).max() < 1e-9:
                break
            good = new

    def _bounded(self, *bad_votes: np.ndarray | float) -> None:
        for k, (low, high) in enumerate(BAD_VOTES):
            self.chance[k, :, 2] = np.clip(bad_votes[k], low, high)
            self.chance[k, :, 1] = 1 - self.chance[k, :, 2]
        self.chance[:, :, 0] = 1.0  # to abstain, as on short texts, tells nothing

    def _posterior(self, patterns: np.ndarray, together: int) -> np.ndarray:
        """Chance of a good text; ``together`` is 1 where good votes hang together and count as one, else 0."""
        says = (patterns[:, None] // _BASE) % 3
        each = np.log(self.chance[:, np.arange(LABELLERS)[None, :], says])
        log = (each * (says == 2)).sum(2) + (each * (says == 1)).sum(2) / np.maximum((says == 1).sum(1), 1) ** together
        log = log + np.log([1 - self.prior, self.prior])[:, None]
        # a text on which all abstain tells nothing but the share of good texts
        return np.where(patterns == 0, self.prior, 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """All but one labeller call a bad text good as a rule, so their good votes count as one here; the rates are estimated with each vote."""
        return self._posterior(patterns, 1)


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and value of each non-zero feature; each text's values of shapes and of words add up to one each."""
    out = []
    for codes, shift in ((w.shape.astype(np.uint64), 0), (w.hashes | U64(SHAPES), 1)):
        place = (mix(codes * U64(2) + U64(shift)) >> U64(64 - BITS)).astype(np.int64)
        pair, n = np.unique((w.text << BITS) | place, return_counts=True)
        text = pair >> BITS
        out.append((text, pair & ((1 << BITS) - 1), n / w.count[text]))
    shapes, named = out
    return np.concatenate([shapes[0], named[0]]), np.concatenate([shapes[1], named[1]]), np.concatenate([4.0 * shapes[2], named[2]])


class Linear:
    """Linear scorer over hashed features."""

    def __init__(self, bias: float) -> None:
        self.weights = np.zeros(1 << BITS)
        self.bias = bias

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Gradient steps with a rate of its own for each weight, over small groups of rows in a fixed order."""
        squares = np.full(1 << BITS, 1e-8)
        at_bias = 1e-8
        order = np.random.default_rng(5).permutation(len(rows))
        for _ in range(PASSES):
            for some in np.array_split(order, max(1, len(order) // 16)):
                places = np.concatenate([rows[i][0] for i in some])
                values = np.concatenate([rows[i][1] for i in some])
                of = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
                z = np.bincount(of, self.weights[places] * values, len(some)) + self.bias
                wrong = labels[some] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                where, which = np.unique(places, return_inverse=True)
                step = np.bincount(which, wrong[of] * values) / len(some) - 1e-6 * self.weights[where]
                squares[where] += step**2
                self.weights[where] += 0.3 * step / np.sqrt(squares[where])
                at_bias += wrong.mean() ** 2
                self.bias += 0.3 * wrong.mean() / np.sqrt(at_bias)

    def scores(self, w: Words) -> np.ndarray:
        text, place, value = features(w)
        z = np.bincount(text, self.weights[place] * value, len(w.count)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pattern(w: Words) -> np.ndarray:
    return votes(w) @ _BASE


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in slices(batches):
        pattern, n = np.unique(_pattern(Words(some.column("text"))), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], names=["pattern", "n"])


class Classifier:
    def __init__(self, model: LabelModel, linear: Linear) -> None:
        self.model, self.linear = model, linear

    def judge(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posterior label and score of each text."""
        w = Words(column)
        score = self.linear.scores(w)
        score[w.count == 0] = self.model.prior
        return self.model.posterior(_pattern(w)), score


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    texts = docs.select("doc_id", "text")
    counted = texts.select("text").mapInArrow(_patterns, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    found = sorted((r["pattern"], r["n"]) for r in counted.collect())  # at most 3**LABELLERS rows
    patterns, counts = np.array(found, np.int64).reshape(-1, 2).T
    model = LabelModel(patterns, counts)
    total = int(counts.sum())
    linear = Linear(float(np.log(model.prior / (1 - model.prior))))

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            w = Words(some.column("text"))
            text, place, value = features(w)
            order = np.argsort(text, kind="stable")
            cuts = np.searchsorted(text[order], np.arange(1, len(w.count)))
            yield pa.RecordBatch.from_pydict(
                {
                    "key": some.column("key"),
                    "label": model.posterior(_pattern(w)),
                    "places": [x.astype(np.int32).tobytes() for x in np.split(place[order], cuts)],
                    "values": [x.astype(np.float32).tobytes() for x in np.split(value[order], cuts)],
                }
            )

    # rows below a hash, so that about `fit_rows` are expected; a tenth of headroom keeps it a bound
    below = int(min(1.0, 0.9 * fit_rows / max(total, 1)) * (1 << 32)) if total > fit_rows else 1 << 32
    key = F.xxhash64("doc_id", "text")
    chosen = texts.withColumn("key", key).where(F.pmod(key, F.lit(1 << 32)) < below).where("text is not null")
    rows = chosen.select("key", "text").mapInArrow(prepared, "key bigint, label double, places binary, values binary").limit(fit_rows).toArrow()
    order = np.argsort(rows.column("key").to_numpy(), kind="stable")
    # views of the rows' own memory, not copies
    places, values = ([np.frombuffer(x.as_buffer(), kind) for x in rows.column(c)] for c, kind in (("places", np.int32), ("values", np.float32)))
    if len(order):
        linear.train([(places[i], values[i]) for i in order], rows.column("label").to_numpy()[order])
    del rows, places, values
    pa.default_memory_pool().release_unused()
    return Classifier(model, linear)


def classified(docs: DataFrame, fit_rows: int = FIT_ROWS, least: float = 0.5) -> DataFrame:
    """All columns of the documents, and ``posterior`` (of the labellers), ``score`` and ``kept`` (score of ``least`` or more)."""
    docs = replaced(docs, ["posterior", "score", "kept"])
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            posterior, score = held.value.judge(some.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*some.columns, pa.array(posterior), pa.array(score), pa.array(score >= least)],
                names=[*some.schema.names, "posterior", "score", "kept"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(work, f"{fields}, posterior double, score double, kept boolean")
