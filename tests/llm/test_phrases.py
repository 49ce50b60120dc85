"""Mined phrases against plain counting over all windows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import phrases
from vellum.llm.queries import QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least=100, longest=5, first=2000):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for m in range(1, longest + 1):
                count[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in count.items():
        frequent = {p: a for p, a in f.items() if a >= least}
        covered = set()
        for p, a in frequent.items():
            for m in range(2, len(p)):
                covered |= {q for q in (p[i : i + m] for i in range(len(p) - m + 1)) if a >= f[q]}
        scored = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in covered:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n[lang], score))
        out += [(lang, i + 1, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(scored)[:first])]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made_rows():
    dice = random.Random(7)
    common = ["the", "The", "of", "in a", "new york city", "ünïcode wörd", "x\ty", "end.", "a,b", "中文 text"]
    rows = [(dice.choice(["en", "de", None]), " ".join(dice.choices(common, k=dice.randrange(60)))) for _ in range(300)]
    return rows + [("fr", None), ("fr", ""), (None, "!?"), ("en", "x y z " * 20_000), ("es", "one two three four five six\n" * 40)] + [("en", "same row here")] * 30


def test_mined_from_made_rows(spark):
    docs = spark.createDataFrame([r + ("mine",) * 4 for r in made_rows()], "lang string, text string, phrase string, a string, rank string, prefix string")
    for least, first in ((20, 2000), (5, 7)):
        got = phrases.mined(docs, least=least, first=first)
        assert got.columns == COLUMNS and found(got) == brute(made_rows(), least, first=first)
    assert found(phrases.mined(docs, least=10**6)) == []
    assert found(phrases.mined(docs.limit(0))) == []
    assert found(phrases.mined(docs, least=20, longest=3)) == brute(made_rows(), 20, longest=3)


def test_a_full_bit_table_changes_nothing(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    monkeypatch.setattr(phrases.bits_of, "__defaults__", (64,))
    assert found(phrases.mined(docs, least=30)) == brute([(r.lang, r.text) for r in docs.collect()], 30)


def test_split_stripes_change_nothing(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    monkeypatch.setattr(phrases, "OCCURRENCES", 50)
    assert found(phrases.mined(docs, least=30)) == brute([(r.lang, r.text) for r in docs.collect()], 30)


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(QUERIES["op13_phrases"](spark, small)) == brute([(r.lang, r.text) for r in docs.collect()])


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t.\n", max_size=30)), min_size=1, max_size=6)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_words_and_pieces(some):
    words = phrases.Words(pa.array(some, pa.string()))
    want = [(w, t, i) for t, text in enumerate(some) for i, p in enumerate(pieces(text)) for w in p]
    assert words.names.take(pa.array(words.codes)).to_pylist() == [w for w, _, _ in want]
    same = [a[1:] == b[1:] for a, b in zip(want, want[1:], strict=False)]
    assert (np.diff(words.piece) == 0).tolist() == same


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 2), st.lists(st.tuples(st.sampled_from("xyz"), st.integers(1, 5)), min_size=1, max_size=4)), max_size=12), st.integers(1, 4))
def test_stripes_are_merged_word_by_word(some, size):
    some.sort(key=lambda r: r[:2])
    columns = [("en", p, part, " ".join(w for w, _ in pairs), np.array([c for _, c in pairs], "<i4").tobytes()) for p, part, pairs in some]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary()]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*columns[i : i + size], strict=True), kinds, strict=True)], names=["lang", "prefix", "part", "nexts", "counts"])
        for i in range(0, len(columns), size)
    ]
    want = defaultdict(Counter)
    for p, part, pairs in some:
        for w, c in pairs:
            want[p, part][w] += c
    got = [r for b in phrases._merge(iter(batches), 3) for r in b.to_pylist()]
    plain = [(p, sum(c.values()), max(c.values()), {w: n for w, n in c.items() if n >= 3}) for (p, _), c in want.items()]
    assert [(r["prefix"], r["total"], r["largest"], dict(zip(r["nexts"], r["counts"], strict=True))) for r in got] == plain
