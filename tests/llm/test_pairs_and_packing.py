import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import jaccard_join, packing
from vellum.llm.graph import components
from vellum.llm.kernels import shingles
from vellum.llm.queries import QUERIES
from vellum.llm.tokens import encoder


def brute(ids, texts, width, num, den):
    sets = shingles(pa.array(texts, pa.string()), width)
    parent = {i: i for i in ids if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(a, sets[j]))
            if ids[i] is not None and ids[j] is not None and common and common * den >= (len(a) + len(sets[j]) - common) * num:
                x, y = sorted((top(ids[i]), top(ids[j])))
                parent[y] = x
    return {i: top(i) for i in parent}, [len(x) for x in sets]


def near_copies(rng):
    """Chains of edits, from equal to unlike, of texts of many lengths, and texts that share one passage."""
    passage = " ".join(f"p{i}" for i in range(60))
    out = []
    for n in (4, 9, 15, 30, 60, 120, 400, 1500):
        base = [f"t{rng.integers(1 << 30)}" for _ in range(n)]
        for _ in range(9):
            out.append(" ".join(base))
            for _ in range(max(1, n // 60)):
                base[rng.integers(n)] = f"t{rng.integers(1 << 30)}"
        out.append(" ".join(base[: n // 2]) + " " + passage)
    return out


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, width, num):
    texts = near_copies(np.random.default_rng(num))
    ids = list(range(100, 100 + len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    want, sizes = brute(ids, texts, width, num, 100)
    got = {r.doc_id: r for r in jaccard_join.grouped(docs, width, num, 100).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert [got[i].n_shingles for i in ids] == sizes


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_unlike_edits_of_one_text_are_not_compared_in_pairs(spark, monkeypatch, width, num):
    rng = np.random.default_rng(num)
    base, passage = [f"b{i}" for i in range(150)], [f"p{i}" for i in range(40)]
    texts = [" ".join([f"o{n}x{i}" for i in range(110)] + passage) for n in range(100)]
    grown: list[list[str]] = [base]
    for n in range(300):  # edits of the text, and edits of edits
        words = list(base if n % 3 else grown[rng.integers(len(grown))])
        for place in rng.integers(0, 150, rng.integers(1, 14)):
            words[place] = f"e{rng.integers(1 << 40)}"
        grown.append(words)
    texts += [" ".join(words) for words in grown]
    ids = [int(i) for i in rng.permutation(len(texts))]
    pairs, table = [], jaccard_join.table

    def counted(df, name):
        out = table(df, name)
        pairs.append(out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(jaccard_join, "table", counted)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.grouped(docs, width, num, 100).collect()}
    assert got == brute(ids, texts, width, num, 100)[0]
    assert 1 < len(set(got.values())) < len(texts)
    assert sum(pairs) < 30 * len(texts)


def test_query_equals_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, sizes = brute([r.doc_id for r in rows], [r.text for r in rows], 3, 90, 100)
    got = sorted(QUERIES["op1_jaccard_join"](spark, small).collect())
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(r.doc_id, n, want[r.doc_id]) for r, n in zip(rows, sizes, strict=True)]


def test_hamming_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(1, 1 << 63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[20:], rng.integers(1, 1 << 63, 30).astype(np.uint64)]))
        bits = int(np.bitwise_count(jaccard_join.sketch(a, 40)[0] ^ jaccard_join.sketch(b, 40)[0]).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_joins_of_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.grouped(odd, 3, 90, 100).collect()}
    assert got[2, 24] == 1 and got[1, 24] == 1 and got[3, 25] == 1
    assert got[4, 0] == 4 and got[5, 0] == 5 and got[6, 0] == 6 and got[7, 1] == 7
    assert all(c is None for (i, _), c in got.items() if i is None)
    kept = jaccard_join.deduplicated(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, 9, 10, 11, None, None])
    assert jaccard_join.grouped(none).count() == 0 and jaccard_join.deduplicated(none).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {7} and got[7] == 7


def packed_well(rows, limit):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        place = 0
        for offset, length in sorted(pieces):
            assert offset == place
            place += length
        assert place <= limit
    return len(by)


def test_packing_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = defaultdict(list)
    found = QUERIES["op7_packing"](spark, small).collect()
    for r in found:
        got[r.doc_id].append(r)
    total = 0
    for row, ids in zip(rows, encoder().encode(pa.array([r.text for r in rows])), strict=True):
        ids, place = np.append(ids, 0).astype("<u4"), 0
        for k, p in enumerate(sorted(got[row.doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, place, zlib.crc32(ids[place : place + p.length].tobytes()))
            assert p.length == 2048 or k == 0
            place += p.length
        assert place == len(ids)
        total += place
    assert packed_well(found, 2048) <= 1.02 * total / 2048 + 1


def test_sweep_places_every_piece_and_fits_best():
    rng = np.random.default_rng(1)
    counts = Counter(np.concatenate([rng.integers(1, 101, 500), np.full(300, 7), np.full(40, 100)]).tolist())
    filled, placed = defaultdict(list), Counter()
    for size, rank, k, each, first, at in packing.sweep(counts, 100):
        assert rank == placed[size]
        placed[size] += k * each
        for i in range(k):
            filled[first + i] += [(at + j * size, size) for j in range(each)]
    assert placed == counts
    for pieces in filled.values():
        ends = 0
        for at, size in sorted(pieces):
            assert at == ends
            ends += size
        assert ends <= 100
    assert len(filled) <= sum(s * n for s, n in counts.items()) / 100 * 1.02 + 1
    assert packing.sweep({}, 100) == []


def test_cuts():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)]


def test_packing_of_odd_rows(spark, odd, none):
    rows = packing.pack(odd, limit=64).collect()
    packed_well(rows, 64)
    assert Counter(r.doc_id for r in rows)[7] == 2
    assert [(r.piece, r.length) for r in rows if r.doc_id == 4] == [(0, 1)]
    assert packing.pack(none).count() == 0
