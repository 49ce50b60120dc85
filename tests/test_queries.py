"""The flagship query and queries against their oracle SQL on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
NAMES = ["descendants", "results", "discover", "resolve_citation_query", "search_all_terms", "search_any_term", "in_degrees", "suffixed_keys", "allocate_ids", "paper_keys", "citation_gaps", "markdown_outlines"]


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, small, name):
    queries, oracle = entry.queries(), entry.oracle_sql()
    if name not in queries:
        pytest.skip("the optional part is absent")
    if name not in oracle:
        pytest.skip("no SQL for it")
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    found = queries[name](spark, small)
    want = con.execute(oracle[name])
    assert ordered(found.columns, found.collect()) == ordered([d[0] for d in want.description], want.fetchall())


@pytest.fixture(scope="module")
def many(spark, small, tmp_path_factory):
    """The smallest tables with five times the benchmark texts, as many as at sf0.1."""
    folder = tmp_path_factory.mktemp("many")
    for path in Path(small).glob("*.parquet"):
        (folder / path.name).symlink_to(path)
    (folder / "benchmark.parquet").unlink()
    rows = spark.read.parquet(f"{small}/benchmark.parquet")
    n = rows.count()
    more = rows.selectExpr("text", f"explode(sequence(item_id, item_id + {4 * n}, {n})) as item_id")
    more.select("item_id", "text").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_every_text_query_has_a_vector(spark, many):
    from vellum.suite import ranking, views

    asked = {r.query_id for r in views.queries(spark, many).collect()}
    got = ranking._query_vectors(spark, many).collect()
    assert len(asked) == 200 and sorted(r.query_id for r in got) == sorted(asked)


def test_every_claim_gets_papers(spark, many):
    """Copies of a claim that have papers with its words have a strength, also beyond the first 40."""
    found = {r.query_id for r in entry.queries()["claim_strength"](spark, many).collect()}
    assert min(found) < 40 and sum(i >= 40 for i in found) > 80
