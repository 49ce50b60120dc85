"""Queries against their SQL on texts that the smallest tables don't have."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_queries import ordered

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def agrees(spark, folder, name):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found = entry.queries()[name](spark, folder)
    want = con.execute(entry.oracle_sql()[name])
    got = ordered(found.columns, found.collect())
    assert got == ordered([d[0] for d in want.description], want.fetchall())
    return got


@pytest.fixture(scope="module")
def odd(spark, small, tmp_path_factory):
    """Thirty documents: lines that end in digits or have spaces around them, and titles with a word that is asked as a fragment."""
    folder = tmp_path_factory.mktemp("odd")
    for path in Path(small).glob("*.parquet"):
        shutil.copy(path, folder / path.name)
    (folder / "documents.parquet").unlink()
    line = F.when(F.col("doc_id") % 3 == 0, F.lit("the Ion of China 100\n 221 \n　call 2220\n\n0333 \t")).otherwise(F.concat(F.lit("CHINAware nation "), F.col("doc_id").cast("string"), F.lit("00\n 1 ")))
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 30").withColumn("text", line).coalesce(1)
    docs.write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_lines_are_trimmed_of_spaces_only(spark, odd):
    assert len(agrees(spark, odd, "embedding_texts")) > 30


def test_fragments_that_are_words_too_are_found(spark, odd):
    got = agrees(spark, odd, "substring_search")
    assert {"103", "104", "105"} <= {r[1] for r in got} and sum(r[1] == "103" for r in got) == 30


def test_scores_are_rounded_once(spark):
    """0.4999995 - 3e-10 is 0.499999 at six digits; by way of nine digits it would be 0.5."""
    from unittest import mock

    from vellum.operators import lexical as lx

    literal = spark.createDataFrame([(1, "P", 0.4999995 - 3e-10)], "query_id int, paper_id string, score double")
    phrases = spark.createDataFrame([("none", "P", 1.0)], "phrase_id string, paper_id string, part double")
    asked = spark.createDataFrame([(1, "w", ["other"])], "query_id int, text string, expansions array<string>")
    index = lx.TextIndex(None, None, None, ("paper_id",), ())
    with mock.patch.object(lx, "match_all", lambda *_: literal), mock.patch.object(lx, "score_phrases", lambda *_: phrases):
        assert [r.score for r in lx.match_expanded(index, asked, digits=6).collect()] == [0.499999]


def test_grams_of_long_texts_are_taken_in_one_pass(spark):
    """A text of 400,000 characters; before, every gram was counted off from the start of the text. Short patterns, line breaks and wide characters count."""
    import time

    from vellum.operators.skew import substring_pairs

    long = "abcdefghij" * 40_000 + "\n\U0001f600Zq"
    texts = [long, "x\ny", "Q", "\U0001f600z", "none"]
    asked = ["j\n\U0001f600z", "Q", "X\nY", "\U0001f600Z", "zq", "absent", ""]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    p = spark.createDataFrame([(x,) for x in asked], "p string")
    began = time.time()
    got = {(r.pattern, r.text) for r in substring_pairs(p, "p", t, "t").collect()}
    assert got == {(a, b) for a in asked for b in texts if a and a.lower() in b.lower()}
    assert time.time() - began < 60


def test_raw_tables_are_not_broadcast(spark, small):
    from vellum.suite import views

    for view in (views.paper_metrics, views.comparisons, views.formulas):
        plan = view(spark, small)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [doc_id" in plan, plan


def test_scans_count_with_the_size_of_their_rows(spark):
    from vellum.session import ROWS_TO_FILE, sized

    name = "spark.sql.sources.fileCompressionFactor"
    had = spark.conf.get(name)
    try:
        spark.conf.set(name, "1.0")
        assert float(sized(spark).conf.get(name)) == ROWS_TO_FILE
        spark.conf.set(name, "3.0")
        assert sized(spark).conf.get(name) == "3.0"
    finally:
        spark.conf.set(name, had)
