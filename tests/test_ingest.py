"""Versioned tables, imports and streams of changes."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.sources.tableset import TableSet
from vellum.streaming import ingest as ing

PACKAGE = (
    "seq long, candidate string, doi string, source_hash string, title string, year int, domain_tags array<string>, author string, processor_version string, force boolean, "
    "claims array<struct<claim:string,claim_type:string,strength:string>>, evidence array<struct<section:string,page:string,source_text:string>>, edges array<struct<target:string,relation:string>>"
)


def package(seq, candidate=None, doi=None, title="T", year=2001, claims=(), edges=(), **more):
    base = {"source_hash": None, "domain_tags": ["ilt"], "author": "Li, Wei", "processor_version": "1", "force": False, "evidence": None}
    return (seq, candidate, doi, *[(base | more)[k] for k in ("source_hash",)], title, year, *[(base | more)[k] for k in ("domain_tags", "author", "processor_version", "force")],
            [(c, "conclusion", "A") for c in claims] if claims is not None else None, (base | more)["evidence"], list(edges))


def test_a_writer_killed_between_tables(spark, tmp_path):
    tables = TableSet(spark, f"file://{tmp_path}/set", {"a": ("id",), "b": ("id",)})
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "id string, n int")
    one = tables.publish("one", {"a": rows, "b": rows})
    bad = rows.withColumn("n", F.expr("if(id = 'y', cast(raise_error('lost') as int), n)"))
    with pytest.raises(Exception, match="lost"):
        tables.publish("two", {"a": rows.withColumn("n", F.col("n") + 10), "b": bad}, replaced=rows.select("id"))
    assert tables.version() == one
    assert sorted(map(tuple, tables.read("a").collect())) == sorted(map(tuple, tables.read("b").collect())) == [("x", 1), ("y", 2)]
    assert tables.publish("one", {"a": rows}) == one  # replayed
    two = tables.publish("two", {"a": rows.where("id = 'y'"), "b": rows.limit(0)}, replaced=rows.where("id = 'y'").select("id"))
    assert two == one + 1
    assert [r.id for r in tables.read("b").collect()] == ["x"] and tables.read("b", version=one).count() == 2
    assert {r.name: r.n_rows for r in tables.counts().collect()} == {"a": 2, "b": 1}


def test_edges_on_replace_and_delete(spark, tmp_path):
    tables = TableSet(spark, f"file://{tmp_path}/set", {"e": ("s",)}, {"e": ("s", "t")})
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), (None, "b")], "s string, t string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    tables.publish("1", {"e": e})
    tables.publish("2", {"e": spark.createDataFrame([("b", "d")], "s string, t string")}, replaced=ids("b"))
    assert sorted(map(str, tables.read("e").collect())) == sorted(map(str, e.where("s is null or s <> 'b'").collect() + [tables.read("e").where("s = 'b'").first()]))
    before = tables.version()
    tables.publish("3", {}, deleted=ids("b"))
    assert [tuple(r) for r in tables.read("e").collect()] == [("c", "a")]
    assert tables.read("e", version=before).count() == 4
    tables.compacted()
    assert [tuple(r) for r in tables.read("e").collect()] == [("c", "a")] and set(tables.batches()) == {"1", "2", "3"}
    tables.publish("4", {"e": e.limit(1)}, deleted=ids("c"))
    assert [tuple(r) for r in tables.read("e").collect()] == [("a", "b")]
    assert tables.publish("2", {"e": e}) == tables.version()


def test_random_batches_against_a_dictionary(spark, tmp_path):
    dice, tables, want = random.Random(4), TableSet(spark, f"file://{tmp_path}/set", {"t": ("id",)}), {}
    for b in range(5):
        ids = [f"k{dice.randrange(8)}" for _ in range(4)]
        drop = {f"k{dice.randrange(8)}" for _ in range(2)} - set(ids)
        rows = sorted({(i, b * 10 + n) for n, i in enumerate(ids)})
        for i in {*ids, *drop}:
            want[i] = [r for r in rows if r[0] == i]
        make = lambda x: spark.createDataFrame([(i,) for i in x], "id string")
        tables.publish(f"b{b}", {"t": spark.createDataFrame(rows, "id string, n int")}, replaced=make(set(ids)), deleted=make(drop))
        if b == 2:
            tables.compacted()
    assert sorted(map(tuple, tables.read("t").collect())) == sorted(r for x in want.values() for r in x)


def test_imports(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, PACKAGE)
    first = make(package(0, claims=["a", "b"]), package(1, "own_id", doi="d1", edges=[("ILT_2001_001", "cites"), ("nothing", "cites")]), package(2, title=" "), package(3, year=None), package(4, doi="d4", source_hash="h"))
    second = make(package(0, doi="d1", title="New", claims=["c"]), package(1, source_hash="h", title="Other"), package(2, title="Fresh", claims=None), package(3, "own_id", title="Newer", claims=["d", "e"]))
    tables = ing.library(spark, f"file://{tmp_path}/library")
    for name, rows in (("one", first), ("one", first), ("two", second)):
        ing.import_packages(rows, tables, name)
    papers = {r.paper_id: r for r in tables.read("papers").collect()}
    assert set(papers) == {"ILT_2001_001", "ILT_2001_002", "ILT_2001_003", "own_id"}
    assert papers["own_id"].title == "Newer" and papers["own_id"].doi is None and papers["own_id"].created_in == "one" and papers["own_id"].updated_in == "two"
    assert sorted(r.citation_key for r in papers.values()) == ["Li2001Fresh", "Li2001T", "Li2001T_a", "Li2001T_b"]
    claims = sorted((r.paper_id, r.claim_id, r.claim) for r in tables.read("claims").collect())
    assert [(p, c) for p, _, c in claims] == [("ILT_2001_001", "a"), ("ILT_2001_001", "b"), ("own_id", "d"), ("own_id", "e")] and len({i for _, i, _ in claims}) == 4
    assert tables.read("edges").count() == 0  # the update of own_id brought none
    jobs = sorted((r.batch_name, r.seq, r.decision, r.paper_id, r.reason, r.edges_left_out) for r in tables.read("jobs").collect())
    assert jobs == [
        ("one", 0, "INSERTED", "ILT_2001_001", None, 0), ("one", 1, "INSERTED", "own_id", None, 1), ("one", 2, "REJECTED", None, "no title", 0),
        ("one", 3, "REJECTED", None, "no year to number it by", 0), ("one", 4, "INSERTED", "ILT_2001_002", None, 0),
        ("two", 0, "UPDATED", "own_id", None, 0), ("two", 1, "BLOCKED", None, None, 0), ("two", 2, "INSERTED", "ILT_2001_003", None, 0), ("two", 3, "UPDATED", "own_id", None, 0),
    ]
    assert [(r.domain, r.year, r.next_value) for r in tables.read("counters").collect()] == [("ILT", 2001, 4)]


def state(tables):
    return sorted(map(tuple, tables.read("items").select("k", "v", "what").collect())), sorted(map(tuple, tables.read("versions").select("k", "v", "deleted").collect())), sorted(map(tuple, tables.read("parts").collect()))


def test_split_repeated_and_shuffled_changes_give_one_state(spark, tmp_path):
    dice = random.Random(9)
    rows = [(f"k{dice.randrange(12)}", v, dice.choice(["set", "set", "drop"])) for v in range(80)] + [(None, 5, "set")]
    schema = "k string, v long, what string"
    gone, parts = F.col("what") == "drop", lambda d: d.select("k", F.explode(F.array("what", F.col("v").cast("string"))).alias("p"))
    whole = ing.changing(spark, f"file://{tmp_path}/whole", "k")
    ing.apply_changes(spark.createDataFrame(rows, schema), whole, "all", "k", ["v"], gone, parts)
    source = f"file://{tmp_path}/source"
    again = rows + dice.sample(rows, 30)
    dice.shuffle(again)
    for part in range(3):
        spark.createDataFrame(again[part::3], schema).coalesce(1).write.parquet(f"{source}/f{part}")
    split = ing.changing(spark, f"file://{tmp_path}/split", "k")
    frame = spark.createDataFrame([], schema).schema
    for _ in range(2):
        ing.follow(spark, f"{source}/*", frame, split, f"file://{tmp_path}/check", "k", ["v"], gone, parts).awaitTermination()
    assert state(split) == state(whole)
    assert len(split.batches()) == 3
    # the micro-batch that was last is sent again by a stream that lost its commit
    last = max(split.batches())
    assert ing.apply_changes(spark.createDataFrame(rows, schema), split, last, "k", ["v"], gone, parts) == split.version()
    want = {}
    for k, v, what in sorted((r for r in rows if r[0]), key=lambda r: r[1]):
        want[k] = (k, v, what)
    assert state(split)[0] == sorted(r for r in want.values() if r[2] == "set")
