"""Toxicity scores against plain Kneser-Ney models counted in dictionaries."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from vellum.llm import toxicity
from vellum.llm.common import table

D, PRIOR = 0.75, 30.0
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    def trimmed(w):
        odd = lambda c: 33 <= ord(c) < 127 and not c.isalnum()
        for _ in range(3):
            if len(w.encode()) > 1 and odd(w[-1]):
                w = w[:-1]
            if len(w.encode()) > 1 and odd(w[0]):
                w = w[1:]
        return w

    for c in SPACE:
        text = text.replace(c, " ")
    return [trimmed("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)) for w in text.split(" ") if w]


class Plain:
    def __init__(self, texts):
        before = [defaultdict(set), defaultdict(set)]
        for text, toxic in texts:
            w = ["", "", *words_of(text)]
            for u, v, x in zip(w, w[1:], w[2:], strict=False):
                before[toxic][v, x].add(u if v else "")
        both = set(before[0]) | set(before[1])
        every = {p: [len(before[k][p]) if p in before[k] else 0 for k in (0, 1)] for p in both}
        self.c = {p: n for p, n in every.items() if sum(n) > 1}
        self.n = defaultdict(lambda: [0, 0])
        for (_, x), n in every.items():
            for k in (0, 1):
                self.n[x][k] += n[k] > 0
        self.shares = [self.levels(self.c.values()), self.levels(self.n.values())]

    @staticmethod
    def levels(counts):
        sums = np.zeros((2, 64))
        for a, b in counts:
            sums[:, (a + b + 1).bit_length() - 1] += a, b
        sums += 1e-6
        every = sums.sum(axis=1) + 1.0
        sums += (100 * every / every.sum())[:, None]
        return sums / sums.sum(axis=0)

    def ratio(self, c, n):
        t, s = self.shares[0][:, int(math.log2(sum(c) + 1))], self.shares[1][:, int(math.log2(sum(n) + 1))]
        share = lambda own, back: [(max(own[k] - D, 0) + (D * sum(x > 0 for x in own) + PRIOR) * back[k]) / (sum(own) + PRIOR) for k in (0, 1)]
        word = share(n, s)
        back = [t[k] * word[k] / s[k] for k in (0, 1)]
        q = share(c, [b / sum(back) for b in back])
        out = math.log(q[1] / t[1]) - math.log(q[0] / t[0])
        return out if abs(out) > 1 else 0.0

    def x(self, text, own=None):
        w = ["", *words_of(text)]
        here = list(zip(w, w[1:], strict=False))
        times, lone = defaultdict(int), defaultdict(int)
        for p in here:
            times[p] += 1
        if own is not None:
            for p in times:
                lone[p[1]] += self.c.get(p, (0, 0))[own] <= times[p]
        total = 0.0
        for p in here:
            c, n = list(self.c.get(p, (0, 0))), list(self.n[p[1]] if p[1] in self.n else (0, 0))
            if own is not None:
                n[own], c[own] = max(n[own] - lone[p[1]], 0), max(c[own] - times[p], 0)
            total += self.ratio(c, n)
        return min(2.0, max(-2.0, total / math.sqrt(max(len(here), 1))))


@pytest.mark.parametrize(("head", "bits"), [(toxicity.HEAD, toxicity.MOST_BITS), (0, toxicity.MOST_BITS), (100, 1 << 12)])
def test_scores_equal_plain_models(spark, small, head, bits):
    """All expressions broadcast, none, and some with a bit table that is full."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = docs.select("doc_id", "text").collect()
    known = [(r.text or "", toxic[r.doc_id]) for r in rows if r.doc_id in toxic]
    plain = Plain(known)
    fitted = toxicity.fit(docs, labels)
    x = np.array([[plain.x(text, own), 1.0] for text, own in known])
    y = np.array([own for _, own in known])
    assert np.allclose(toxicity.logistic(x, y), fitted.weights, atol=1e-3)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, fitted, head, bits).collect()}
    want = {r.doc_id: 1 / (1 + math.exp(-(plain.x(r.text or "") * fitted.weights[0] + fitted.weights[1]))) for r in rows}
    assert got.keys() == want.keys() and all(abs(want[i] - s) < 1e-5 for i, s in got.items())
    assert len(set(got.values())) > 1


def test_copies_count_alike_and_once(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    fitted = toxicity.fit(docs, labels)
    one = {r.doc_id: r.score for r in toxicity.scored(docs, fitted).collect()}
    many = table(docs.unionByName(docs).unionByName(docs).repartition(7), "thrice")
    got = toxicity.scored(many, fitted, head=50).collect()
    assert len(got) == 3 * docs.count() and all(r.score == one[r.doc_id] for r in got)
