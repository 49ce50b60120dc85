"""The prefix trie against a dictionary of prefixes, and its queue against a sorted list."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import prefix_trie
from vellum.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, k1 string, n_convs string, rank string, part string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, d == len(whole)))
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, some in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(some) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, some in members.items():
        ends = ",".join(str(c) for c, end in sorted(some) if end)
        parent = min(members[node[:-1]])[0] if node else None
        out.append((min(some)[0], len(node), parent, len(some), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[:2])


def odd_rows():
    rows = []
    for c in range(-12, 60):  # many conversations of few texts
        rows += [(c, t, "user" if t % 2 == 0 else None, f"word {t} {(c // 5 * t) % 3}") for t in range((c * 7) % 12)]
    for c in range(100, 140):  # copies
        rows += [(c, t, "user", "the same") for t in range(4)]
    rows += [(200, t, "user", f"long {t}") for t in range(150)] + [(201, t, "user", f"long {t}") for t in range(12)]
    rows += [(300, 1, "b", "x"), (300, 1, "a", "y"), (300, 1, "a", "y"), (300, None, "z", None), (300, None, None, "")]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None), (301, 0, "user", "wörd " * 30_000), (302, 0, "ab", "c"), (303, 0, "a", "bc")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    """Small partitions stay apart, so that conversations go over several of them."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark.createDataFrame([r + ("mine",) * 5 for r in odd_rows()], SCHEMA)
    spark.conf.unset(name)


def test_trie_of_odd_rows(odd):
    assert found(prefix_trie.trie(odd)) == brute(odd_rows())


def test_no_rows_no_nodes(spark, odd):
    empty = prefix_trie.trie(odd.limit(0))
    assert empty.columns == COLUMNS and empty.count() == 0
    assert prefix_trie.trie(odd.where("conv_id is null")).count() == 0


def test_query_against_dictionary(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found(QUERIES["op12_prefix_trie"](spark, small)) == brute([tuple(r) for r in rows])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 3), max_size=60), st.integers(1, 7))
def test_queue_with_spilled_runs(items, most):
    queue = prefix_trie.Queue(most)
    for n, x in enumerate(items):
        queue.push((*x, n, 0, 1))
    out = [i for address in sorted(set(items)) for i in queue.pop_to(address)]
    assert out == sorted((*x, n, 0, 1) for n, x in enumerate(items)) and queue.empty()


def test_a_small_queue_changes_nothing(odd, monkeypatch):
    passed = prefix_trie.passed_up
    monkeypatch.setattr(prefix_trie, "passed_up", lambda batches: passed(batches, 2))
    assert found(prefix_trie.trie(odd)) == brute(odd_rows())
