import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vellum.llm import fingerprints, html_text, mixing, quality_rules, sharding, token_files, toxicity, weak_quality
from vellum.llm.common import new_path
from vellum.llm.queries import QUERIES
from vellum.llm.tokens import encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()


# ---- mixing


def test_mix_meets_targets(spark, small):
    rows = {r.doc_id: r for r in rows_of(spark, small)}
    got = QUERIES["op2_mixing"](spark, small).collect()
    assert len(got) == len(rows)
    taken, size, target, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        s = rows[r.doc_id].source
        assert r.size == len(WORD.findall(rows[r.doc_id].text)) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        size[s] += r.size
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.source_size == sum(len(WORD.findall(x.text)) for x in rows.values() if x.source == s)
    weights = dict(zip(sorted(size), [5, 2, 1] * 99, strict=False))
    want, left, share = {}, dict(size), sum(size.values())
    while True:  # stop at three times the source, share the rest by weight
        level = share / sum(weights[s] for s in left)
        full = [s for s in left if 3 * size[s] <= level * weights[s]]
        if not full:
            break
        for s in full:
            want[s] = 3 * size[s]
            share -= want[s]
            del left[s]
    want |= {s: level * weights[s] for s in left}
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= largest[s]
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op2_mixing"](spark, small).collect()))


def test_budgets_are_nested(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    less, more = ({r.doc_id: r.taken for r in mixing.mix(docs, total=n).collect()} for n in (20_000, 40_000))
    assert all(less[i] <= more[i] for i in less) and sum(less.values()) < sum(more.values())


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == 15 and all(r.taken == 0 for r in got if r.size == 0)
    assert len({r.taken for r in got if r.doc_id == 7}) == 1
    assert mixing.mixed_documents(odd).columns == odd.columns
    copies = Counter((r.doc_id, r.text) for r in mixing.mixed_documents(odd).collect())
    want = Counter()
    for r, o in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.size)), sorted(odd.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, len(WORD.findall(r.text or "")))), strict=True):
        want[o.doc_id, o.text] += r.copies
    assert copies == +want
    assert mixing.mix(none).count() == 0


# ---- sharding


def test_permutation_and_its_inverse():
    for n in (1, 2, 3, 10, 97, 1000, 4097):
        f = sharding.Feistel(n, key=9)
        there = f.forward(np.arange(n))
        assert sorted(there.tolist()) == list(range(n)) and (f.inverse(there) == np.arange(n)).all()
    assert (sharding.Feistel(1000, 1).forward(np.arange(1000)) != sharding.Feistel(1000, 2).forward(np.arange(1000))).any()


def test_shards(spark, small):
    rows = rows_of(spark, small)
    got = sorted(QUERIES["op8_sharding"](spark, small).collect())
    assert [(r.doc_id, r.size, r.text_crc32) for r in got] == [(r.doc_id, len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in rows]
    slots = defaultdict(list)
    for number, r in enumerate(got):
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
        assert sharding.row_at(len(got), 40, r.shard, r.slot) == number
    assert set(slots) <= set(range(40)) and max(map(len, slots.values())) - min(len(slots[k]) for k in range(40)) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_odd_rows(odd, none):
    got = sharding.shard(odd, 4).collect()
    assert sorted(r.place for r in got) == list(range(15)) and {r.size for r in got if r.doc_id in (4, 5)} == {16}
    assert sharding.shard(none, 4).count() == 0


# ---- quality rules


def measured(text):
    words = WORD.findall(text or "")
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {r for r, n in Counter(runs).items() if n > 1}
    covered = {i + k for i, r in enumerate(runs) if r in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, small):
    rows = rows_of(spark, small)
    got = sorted(QUERIES["op10_quality_rules"](spark, small).collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    lost = 0
    for r, row in zip(got, rows, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(row.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        lost += labels.get(r.doc_id) == 1 and not r.base_failed and not r.kept
    assert lost == 0
    assert any(not r.base_failed and not r.kept for r in got)


def test_buckets_keep_eight_bits(spark):
    values = [0, 1, 255, 256, 257, 511, 512, 1000, 123_456]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select(quality_rules._bucket(F.col("v")).alias("b")).collect()
    assert [r.b for r in got] == [v >> max(0, v.bit_length() - 8) << max(0, v.bit_length() - 8) for v in values]


def test_rules_on_odd_rows(odd, none):
    got = quality_rules.judged(odd).collect()
    assert len(got) == 15 and all(r.base_failed for r in got if r.doc_id != 9)
    assert {(r.n_words, r.word_chars) for r in got if r.doc_id in (4, 5, 6)} == {(0, 0)}
    assert quality_rules.judged(none).count() == 0


# ---- toxicity and weak labels


def test_toxicity_learns_and_scores(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = [words[k] for k in rng.zipf(1.3, 80) % 400]
        toxic = i % 8 == 0
        for _ in range(4 * toxic):
            text[rng.integers(80)] = ("scum", "idiot", "trash!")[rng.integers(3)]
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic) if i % 3 else None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = {r.doc_id: r for r in toxicity.classified(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    out = [r for r in got.values() if r.held_out]
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_every_word_and_pair_has_counts_of_its_own(spark):
    """More words than the 2**18 places that counts once shared: each is told apart, none is added to another."""
    n = 300_000
    rows = [(" ".join(f"v{k}" for k in range(i, i + 1000)), i // 1000 % 2) for i in range(0, n, 1000)]
    rows += [("left again here", 0), ("right again here", 1), ("right again here", 1)]
    docs = spark.createDataFrame(rows, "text string, toxic int").repartition(4)
    got = {(r.kind, r.code): (r.c0, r.c1, r.n0, r.n1) for r in toxicity.counts_of(docs).collect()}
    names = pa.array([f"v{i}" for i in range(n)] + ["again", "here"])
    codes = toxicity.word_codes(names)[0]
    assert len(set(codes.tolist())) >= n - 50  # codes of 32 bits
    alone = [got[1, c] == (i // 1000 % 2 == 0, i // 1000 % 2, i // 1000 % 2 == 0, i // 1000 % 2) for i, c in enumerate(codes[:n].tolist())]
    assert sum(alone) >= n - 100
    again, here = codes[n:].tolist()
    assert got[1, again] == (1, 1, 1, 1) and got[1, here] == (1, 1, 1, 1)
    assert [(c, x) for (k, c), x in got.items() if k == 0] == [(again << 32 | here if again < 1 << 31 else (again << 32 | here) - (1 << 64), (1, 1, 1, 1))]


def test_toxicity_of_odd_rows(spark, odd, none, small):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (9, 0), (8, 1), (8, 0)], "doc_id bigint, toxic int")
    got = toxicity.classified(odd, labels)
    assert got.where("score between 0 and 1").count() == 15 and set(odd.columns) == set(got.columns)
    assert got.where("doc_id = 7").select("score").distinct().count() == 1
    for some, few in ((odd, labels.where("toxic = 0")), (odd, labels.limit(0)), (none, labels)):
        assert toxicity.classified(some, few).where("predicted = 1").count() == 0


def test_labels_have_no_part_in_held_out_scores(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.classified(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_weak_labels_tell_junk_from_prose(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op4_weak_quality"](spark, small).collect()}
    assert all(got[i].kept for i, q in labels.items() if q == 1)
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(not got[i].kept for i in bad) >= 0.8 * len(bad)


def test_weak_labels_on_odd_rows(odd, none):
    got = weak_quality.classified(odd)
    assert got.count() == 15 and got.where("kept").count() >= 13
    assert got.where("doc_id = 7").select("score").distinct().count() == 1
    assert weak_quality.classified(none).count() == 0


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.9
    bad_vote = np.where(good[:, None], rng.random((20_000, 8)) < 0.004, rng.random((20_000, 8)) < 0.3)
    says = np.where(rng.random((20_000, 8)) < 0.1, 0, 1 + bad_vote)
    patterns, counts = np.unique(says @ weak_quality._BASE, return_counts=True)
    model = weak_quality.LabelModel(patterns, counts)
    assert abs(model.prior - 0.9) < 0.03 and np.abs(model.chance[0, :, 2] - 0.3).max() < 0.06


def test_a_labeller_that_is_often_wrong_is_outvoted():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.9
    bad_vote = np.where(good[:, None], rng.random((20_000, 8)) < 0.004, rng.random((20_000, 8)) < 0.3)
    bad_vote[:, 3] = rng.random(20_000) < 0.2  # bad on good texts and on bad ones alike
    says = 1 + bad_vote
    patterns, counts = np.unique(says @ weak_quality._BASE, return_counts=True)
    model = weak_quality.LabelModel(patterns, counts)
    assert model.chance[1, 3, 2] > 0.1 and np.delete(model.chance[1, :, 2], 3).max() < 0.01
    alone = (says == 2).sum(1) == 1
    kept = model.posterior(says @ weak_quality._BASE) > 0.5
    assert kept[alone & bad_vote[:, 3]].all() and not kept[alone & ~bad_vote[:, 3]].any()
    assert kept[good].mean() > 0.96 and (~kept[~good]).mean() > 0.85


# ---- token files


def test_token_files(spark, small):
    rows = rows_of(spark, small)
    place = 0
    for r, row, ids in zip(sorted(QUERIES["op5_token_files"](spark, small).collect()), rows, encoder().encode(pa.array([r.text for r in rows])), strict=True):
        ids = np.append(ids, 2).astype("<u4")
        assert tuple(r) == (row.doc_id, place, len(ids), zlib.crc32(ids.tobytes()))
        place += len(ids)


def test_sequences_and_masks(spark, odd, none):
    folder = new_path(spark, "files")
    shards = token_files.write(odd, folder, length=16)
    total = seen = 0
    for s in shards.collect():
        shard = token_files.Shard(folder, s.part)
        n = -(-s.n_tokens // 16)
        parts = [shard.sequence(i) for i in range(n)]
        assert all(len(a) == len(m) == 16 for a, m in parts)
        flat = np.concatenate([a[np.array(m)] for a, m in parts])
        assert (flat == shard.ids(0, s.n_tokens)).all()
        total, seen = total + s.n_tokens, seen + s.n_docs
    assert seen == 15 and total == sum(r.n_tokens for r in token_files.read(spark, shards, folder).collect())
    assert {r.n_tokens for r in token_files.encoded(odd).where("doc_id in (4, 5)").collect()} == {1}
    assert token_files.encoded(none).count() == 0


# ---- fingerprints


def test_fingerprints(spark, small):
    rows = rows_of(spark, small)[::-1]
    got = {r.doc_id: r for r in QUERIES["op6_fingerprints"](spark, small).collect()}
    assert len(got) == len(rows)
    for k, row in enumerate(rows):
        following = rows[(k + 1) % len(rows)].text
        edit = row.text[: len(row.text) - len(row.text) // 2] + following[: len(row.text) // 2]
        own, new, after = fingerprints.signatures([row.text, edit, following])
        r = got[row.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(row.text), hashlib.sha256(edit.encode()).hexdigest())
        assert (fingerprints.from_printable(r.fingerprint), fingerprints.from_printable(r.edited_fingerprint)) == (own, new)
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, new), fingerprints.likeness(own, after))


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(2)
    off = []
    for _ in range(150):
        n, cut = int(rng.integers(8, 2000)), rng.random()
        a = [f"w{rng.integers(1 << 40)}" for _ in range(n)]
        b = a[: int(n * cut)] + [f"w{rng.integers(1 << 40)}" for _ in range(n - int(n * cut))]
        x, y = ({tuple(z[i : i + 5]) for i in range(len(z) - 4)} for z in (a, b))
        off.append(fingerprints.likeness(*fingerprints.signatures([" ".join(a), " ".join(b)])) - len(x & y) / len(x | y))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.045


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprints.compared(odd).collect()
    assert len(got) == 15
    prints = defaultdict(set)
    for r in got:
        prints[r.doc_id].add(bytes(r.fingerprint))
    assert prints[1] == prints[2] and prints[4] == prints[5] == prints[6] == {b""} and len(prints[7]) == 1
    assert fingerprints.compared(none).count() == 0
    alone = fingerprints.compared(odd.where("doc_id = 1")).first()
    assert alone.near_next == 1.0


# ---- main text


PAGE = """<html><head><title>t</title><script>var x = "</p><p>no";</script><style>p{}</style></head><body class="has-sidebar">
<nav><ul><li><a href=/>Home</a></ul></nav><header><p>Site</p></header><div class="ad">Buy</div><div class="cookie-notice"><p>ok?</p></div>
<div class="col-3"><article><h1>The &amp; title</h1><p>First   <b>bold<p>Second &lt;i&gt; <a href="a>b">link</a>.<br>more<ul><li>one<li>two</ul>
<form><input><p>mail</p></form><aside>side</aside></article><div class="comments"><p>nonsense</p></div></div><footer>&copy;</footer></body></html>"""
TEXT = "The & title\nFirst bold\nSecond <i> link. more\none\ntwo"


def test_main_text(spark, none):
    pages = [(1, "http://a.example/x", PAGE, "q"), (2, "http://www.a.example:80/y", PAGE.replace("col-3", "col-77"), "q"), (3, None, None, "q"), (4, "x", "", "q")]
    pages += [(5, "http://a.example/z", "<p>no such path</p>", "q"), (5, "http://a.example/z", "<p>no such path</p>", "q"), (None, "http://a.example/y", "plain < text &bull; x", "q")]
    pages += [(6, "http://a.example/l", "<div>" * 3000 + "deep <p cla", "q")]
    got = {(r.page_id, r.url): r for r in html_text.extracted(spark.createDataFrame(pages, "page_id bigint, url string, html string, path string")).collect()}
    text = {k[0]: r.text for k, r in got.items()}
    assert text[1] == text[2] == TEXT and text[3] == text[4] == "" and text[5] == "no such path" and text[None] == "plain < text • x" and text[6] == "deep"
    assert got[1, "http://a.example/x"].n_chars == len(TEXT)
    assert html_text.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_hosts_vote(spark):
    odd_page = '<body><div class="a"><p>short words here</p></div><div class="b1"><p>' + "long " * 40 + "</p></div></body>"
    even = '<body><div class="a"><p>' + "text " * 40 + '</p></div><div class="b2"><p>x</p></div></body>'
    rows = [(i, "http://h/", even) for i in range(3)] + [(9, "http://h/", odd_page)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[9] == "short words here\n" + " ".join(["long"] * 40) and got[0] == " ".join(["text"] * 40) + "\nx"


def test_main_text_is_kept_whole():
    lead, body = "l" * 150, "b" * 850
    text = lambda html, path=None: html_text.Page(html).text(path)
    assert text(f'<body><div class="post"><div>{lead}</div><div>{body}</div></div></body>') == f"{lead}\n{body}"
    assert text("<main><p>intro</p></main><article><p>more</p></article><p>out") == "intro\nmore"
    inner = '<div class="related-work">a</div><div class="comment-on-law">b</div><p class="disclaimer">c</p><p class="ad">no</p><div class="related-posts">no</div><div id="shareButtons">no</div>'
    assert text(f"<article>{inner}</article>") == "a\nb\nc"
    # the host's path holds a lead that the page's own article doesn't, and is never a reason to lose the article
    page = '<body><div class="post"><p>lead</p><article><p>text</p></article></div><p>beside</p></body>'
    assert text(page, "html>body>div.post") == "lead\ntext" and text(page, "html>body>div.none") == text(page, "html>body") == "text"
    assert text('<body><article><p>own</p></article><div class="x">small</div></body>', "html>body>div.x") == "own\nsmall"


def test_memory_of_deep_pages_is_linear():
    import tracemalloc

    def peak(depth):
        tracemalloc.start()
        page = html_text.Page("<div>" * depth + "deep")
        assert page.text(page.path(page.best()[0])) == "deep"
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    assert peak(12_000) < 3 * peak(6_000)


def test_every_page_of_the_query(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op9_html_text"](spark, small).collect()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) > 0 for r in got.values())
