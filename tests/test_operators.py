"""Operators on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import lexical, rank, skew
from vellum.session import shared_dir, written


def test_running_total_over_ranges(spark):
    rows = spark.createDataFrame([("a", i, i % 3) for i in range(50)] + [("b", 7, 5)], "k string, at bigint, v bigint")
    got = {(r.k, r["at"]): r.s for r in skew.running_total(rows, ["k"], "at", "v", "s", width=8).collect()}
    assert all(got["a", i] == sum(j % 3 for j in range(i + 1)) for i in range(50)) and got["b", 7] == 5


def test_top_k_breaks_ties(spark):
    rows = spark.createDataFrame([("q", i, i // 2) for i in range(10)], "q string, id int, score int")
    got = skew.top_k(rows, ["q"], [F.desc("score"), F.asc("id")], 3).orderBy("rank").collect()
    assert [r.id for r in got] == [8, 9, 6]


def test_substring_pairs_find_every_place(spark):
    p = spark.createDataFrame([("ab",), ("zzz",), ("B",)], "p string")
    t = spark.createDataFrame([("xABy",), ("b",), (None,), ("q",)], "t string")
    got = {(r.pattern, r.text) for r in skew.substring_pairs(p, "p", t, "t").collect()}
    assert got == {("ab", "xABy"), ("B", "xABy"), ("B", "b")}


def test_descendants_of_chains_diamonds_and_cycles(spark):
    chain = [(f"c{i}", [f"c{i + 1}"]) for i in range(20)]
    other = [("top", ["l", "r"]), ("l", ["end"]), ("r", ["end"]), ("x", ["y"]), ("y", ["x"]), ("none", [])]
    concepts = spark.createDataFrame(chain + other, "concept_id string, child_concepts array<string>")
    got = {(r.ancestor, r.descendant): r.depth for r in rank.descendants(concepts).collect()}
    assert got["c0", "c20"] == 20 and sum(a.startswith("c") for a, _ in got) == 20 * 21 // 2
    assert got["top", "end"] == 2 and got["x", "y"] == got["y", "x"] == 1 and ("x", "x") not in got


def test_fallback_knows_its_columns(spark):
    docs = spark.createDataFrame([("p1", "a title")], "paper_id string, title string")
    q = spark.createDataFrame([("q", "tit")], "query_id string, text string")
    none = q.limit(0).select("query_id")
    assert lexical.substring_fallback(q, none, docs, ["paper_id"], ["title"]).count() == 1
    with pytest.raises(ValueError, match="one_line"):
        lexical.substring_fallback(q, none, docs, ["paper_id"], ["title", "one_line"])


def test_written_tables_keep_rows_and_types(spark):
    rows = spark.createDataFrame([(1, None, [1.5]), (2, "x", [])], "a int, b string, c array<double>")
    again = written(rows, "t")
    assert again.dtypes == rows.dtypes and sorted(again.collect()) == sorted(rows.collect())
    # the folder may be named with or without a scheme
    assert shared_dir(spark).removeprefix("file:").lstrip("/") in again.inputFiles()[0]
