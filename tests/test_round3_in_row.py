"""Searches that score each row where it lies, against the search by postings and against plain loops."""

import random

from pyspark.sql import functions as F

from vellum.operators import lexical as lx
from vellum.operators.skew import containing


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def corpus_of(spark, n=300):
    dice = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(dice.choices(words, weights=[40 / (i + 1) for i in range(40)], k=dice.randrange(12)))
    docs = spark.createDataFrame([(f"p{i}", text()) for i in range(n)] + [("none", None)], "paper_id string, body string").repartition(5)
    queries = spark.createDataFrame([(q, text() + " w3 w3") for q in range(6)] + [(9, "unknown"), (10, "w39 unknown")], "query_id long, text string")
    return lx.build_index(docs, ["paper_id"], ["body"]), lx.query_terms(queries)


def test_in_row_scores_equal_those_by_postings(spark):
    index, terms = corpus_of(spark)
    by_postings = lx.replace(index, rows=None)
    assert rows_of(lx.match_any(index, terms)) == rows_of(lx.match_any(by_postings, terms))
    assert rows_of(lx.match_all(index, terms)) == rows_of(lx.match_all(by_postings, terms))
    for k in (1, 3, 1000):
        short = [lx.best(lx.match_any(x, terms, k=k), ["paper_id"], k) for x in (index, by_postings)]
        assert rows_of(short[0]) == rows_of(short[1])
    met = index.postings.join(terms, "term").groupBy("query_id", "paper_id").count()
    assert rows_of(lx.match_any(index, terms, also=["matched"]).drop("score")) == rows_of(met)


def test_postings_are_not_moved(spark):
    index, terms = corpus_of(spark, 50)
    for found in (lx.match_any(index, terms), lx.match_all(index, terms)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan, plan


def test_containing_equals_plain_containment(spark):
    """Patterns with words inside, with spaces at their ends or in a row, short ones and fragments; no piece of a text is stored."""
    dice = random.Random(5)
    text = lambda n: "".join(dice.choices("aBéÉ \n", k=n))
    texts = [text(dice.randrange(40)) for _ in range(200)] + ["the Ion of China", "ion  of", "", " a ", "ΟΔΟΣ ab c"]
    asked = [text(dice.randrange(1, 7)) for _ in range(60)] + ["", "e ion OF ch", "ion  of", " of ", "ion of", "  ", "a", "absent words in here", "σ AB c"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(-1, None)], "i int, t string")
    p = spark.createDataFrame([(x,) for x in asked], "p string")
    got = {(r.pattern, r.i) for r in containing(p, "p", t, "t").collect()}
    low = F.instr(F.lower("t"), F.lower("p")) > 0
    want = {(r.p, r.i) for r in p.where("p <> ''").crossJoin(t).where(low).collect()}
    assert got == want and len(want) > 200


def test_an_index_is_one_table(spark):
    index, _ = corpus_of(spark, 20)
    kept = lx.persisted(index)
    assert set(kept.postings.inputFiles()) == set(kept.docs.inputFiles())
    assert rows_of(kept.postings) == rows_of(index.postings) and rows_of(kept.stats) == rows_of(index.stats)


def test_phrases_are_found_at_each_place(spark):
    """Also where a phrase overlaps itself, repeats its rarest word or would span two columns; texts are not looked up again."""
    docs = [("a", "x x x", "y x"), ("b", "x y x y x", None), ("c", "x", "y"), ("d", "q Y, x-y", "y y"), ("e", None, "")]
    index = lx.build_index(spark.createDataFrame(docs, "paper_id string, one string, two string"), ["paper_id"], ["one", "two"])
    asked = ["x x", "x y x", "y", "x y", "y x y", "absent x", ""]
    found = lx.match_phrases(index, spark.createDataFrame([(t, t) for t in asked], "phrase_id string, text string"))
    assert found._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 0
    got = {(r.phrase_id, r.paper_id): r.tf for r in found.collect()}
    tokens = {i: [x.lower().replace(",", "").replace("-", " ").split() for x in (a or "", b or "")] for i, a, b in docs}
    places = lambda t, p: sum(t[i:i + len(p)] == p for i in range(len(t) - len(p) + 1))
    want = {(p, i): sum(places(t, p.split()) for t in cols) for p in asked if p for i, cols in tokens.items()}
    assert got == {k: n for k, n in want.items() if n}
    assert {(r.paper_id, r.dl) for r in found.collect()} <= {("a", 5), ("b", 5), ("c", 2), ("d", 6)}


def test_pairs_may_bring_their_features(spark):
    from vellum.operators import rank as rk

    papers = spark.createDataFrame([("A_2000_001", 2000, "v", ["en"], ["m1"], "w1"), ("B_2001_001", None, None, [], ["m2"], "w1 w2")],
                                   "paper_id string, year int, venue string, domain_tags array<string>, method_tags array<string>, title string")
    queries = spark.createDataFrame([(1, "w1", 1999, None, "a", None, None), (2, "w2", None, None, None, "m2", "v")],
                                    "query_id long, text string, year_from int, year_to int, domain string, method string, venue string")
    index, terms = lx.build_index(papers, ["paper_id"], ["title"]), lx.query_terms(queries)
    features = [c for c in rk.PAPER_FEATURES if c != "paper_id"]
    brought = rk.check_pairs(lx.match_any(index, terms, also=features), queries)
    looked_up = rk.check_pairs(lx.match_any(index, terms), queries, papers)
    cols = ["query_id", "paper_id", "score", "year", "passes", "metadata"]
    assert rows_of(brought.select(cols)) == rows_of(looked_up.select(cols)) and brought.count() == 3
    assert "paper_id" not in [c for line in brought._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line for c in line.replace("#", " ").split()]
