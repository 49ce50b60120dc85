"""Citation rewriting against a regular expression, and review rounds."""

import random
import re

from pyspark.sql import functions as F

from vellum.operators import manuscripts as ms


def rewritten(body, allowed):
    dropped = []

    def one(m):
        keys = [k.strip() for k in m[1].split(",") if k.strip()]
        dropped.extend(k for k in keys if k not in allowed)
        kept = [k for k in keys if k in allowed]
        return f"{m[0].split('{')[0]}{{{','.join(kept)}}}" if kept else ""

    return re.sub(r"\\cite[a-zA-Z]*\{([^}]*)\}", one, body or ""), dropped


def test_rewriting(spark):
    dice = random.Random(1)
    keys = ["good", "bad", " good ", "x", "", "good", "ünï"]
    command = lambda: f"\\cite{dice.choice(['', 'p', 't', 'author'])}{{{','.join(dice.choices(keys, k=dice.randrange(5)))}}}"
    body = lambda: "".join(dice.choice(["text ", "{\\em x}", "\\citep", "$1", "\\", "\n", command(), command()]) for _ in range(dice.randrange(9)))
    rows = [(f"m{i % 5}", f"s{i}", body()) for i in range(80)] + [("m0", "null", None), ("m9", "none", "\\cite{good}"), (None, "lost", "\\cite{good,x}")]
    allowed = [("m0", "good"), ("m0", "good"), ("m1", "x"), ("m2", "good"), ("m2", "x"), ("m3", "ünï")]
    by = {m: {k for n, k in allowed if n == m} for m, _, _ in rows}
    clean, dropped = ms.sanitize(spark.createDataFrame(rows, "manuscript_id string, name string, body string"), spark.createDataFrame(allowed, "manuscript_id string, key string"))
    want = {name: rewritten(text, by[m]) for m, name, text in rows}
    assert {r.name: r.body for r in clean.collect()} == {k: b for k, (b, _) in want.items()} and clean.count() == len(rows)
    got = {}
    for r in sorted(dropped.collect(), key=lambda r: (r.name, r.place)):
        got.setdefault(r.name, []).append(r.key)
    assert got == {k: d for k, (_, d) in want.items() if d}


def test_gaps_and_labels(spark):
    sections = spark.createDataFrame([("m", "a", "\\cite{k1,k2}\\label{x}"), ("m", "b", "\\label{x}\\label{y}"), ("n", "a", None)], "manuscript_id string, name string, body string")
    bib = spark.createDataFrame([("m", "k2"), ("m", "k3"), ("n", "k1"), ("n", "k1")], "manuscript_id string, key string")
    assert sorted(map(tuple, ms.citation_gaps(sections, bib).collect())) == [("m", "k1", "missing"), ("m", "k3", "orphan"), ("n", "k1", "orphan")]
    assert [tuple(r) for r in ms.duplicate_labels(sections).collect()] == [("m", "x", 2)]


def test_reviews(spark):
    cases = {"Ready": "ready", "not ready": "not ready", "NOT yet ready": "not ready", "almost": "almost", "not quite": "almost", None: "not ready", "": "not ready", "already there": "ready"}
    rows = spark.createDataFrame([("m", i, "n/a" if i % 2 else "7.5", t) for i, t in enumerate(cases)], "manuscript_id string, round int, score_text string, verdict_text string")
    got = {r.round: r for r in ms.normalize_reviews(rows).collect()}
    assert [got[i].verdict for i in range(len(cases))] == list(cases.values()) and got[0].score == 7.5 and got[1].score == 0
    assert ms.normalize_reviews(rows, literal=True).where("round = 1").first().verdict == "ready"
    rounds = [("a", 1, 5.0, "ready"), ("a", 2, 6.0, "almost"), ("a", 3, 9.0, "ready"), ("b", 1, 9.0, "not ready"), ("b", 2, 1.0, "ready"), ("c", 4, 6.0, "ready")]
    out = ms.review_outcome(spark.createDataFrame(rounds, "manuscript_id string, round int, score double, verdict string"))
    assert sorted(map(tuple, out.collect())) == [("a", 2, 6.0, "almost", "positive_assessment", 2), ("b", 2, 1.0, "ready", "max_rounds", 2), ("c", 4, 6.0, "ready", "positive_assessment", 1)]
    assert out.where(F.col("n_rounds") > 2).count() == 0
