"""Queries of the training-data operators against their SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from vellum.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6) + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["op2_mixing", "op10_quality_rules", "op11_warc", "op12_prefix_trie", "op13_phrases"])
def test_query_agrees_with_sql(spark, small, name):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    found = QUERIES[name](spark, small)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    rows = lambda columns, data: sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in data)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, want.fetchall())
