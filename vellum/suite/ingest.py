"""Import and change-stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.session import shared_dir
from vellum.streaming import ingest as ing
from vellum.suite import views as v
from vellum.suite.registry import query


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- J6: a stream of changes -----------------------------------------------------------


def _followed(spark, sf):
    """All events as changes of their user, in files of a stream that is stopped and goes on."""
    events = v.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    source, check = _folder(spark, "changes"), _folder(spark, "stream")
    # late and repeated changes: files are dealt by event, not by time, and every tenth event comes twice
    again = events.where("event_id % 10 = 0").withColumn("event_id", F.col("event_id"))
    events.unionByName(again).repartition(4, "event_id").write.parquet(source)
    tables = ing.changing(spark, _folder(spark, "accounts"), "user_id")
    schema = spark.read.parquet(source).schema

    def parts(rows):
        return rows.select("user_id", F.explode(F.array("event_type", "props")).alias("part"))

    for _ in range(2):  # the second run finds nothing new
        ing.follow(spark, source, schema, tables, check, "user_id", ["ts", "event_id"], F.col("event_type") == "error", parts).awaitTermination()
    return tables


_LATEST = """with l as (select * from events where user_id is not null qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"""


@query(f"""{_LATEST} select user_id, event_id, event_type, value, props, array_to_string(list_sort([event_type, props]), '|') as parts from l where event_type <> 'error'""")
def followed_changes(spark, sf):
    """The latest state of every user and its child rows."""
    tables = _followed(spark, sf)
    parts = tables.read("parts").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("part")), "|").alias("parts"))
    return tables.read("items").join(parts, "user_id").select("user_id", "event_id", "event_type", "value", "props", "parts")


# ---- J5, J1, J3, A15, A16: importing packages -----------------------------------------


def _packages(spark, sf):
    """Every document as a package: three of its lines as evidence, the first as claim, an edge to one that brings its id."""
    p = v.papers(spark, sf)
    i = F.col("doc_id")
    lines = v.chunks(spark, sf).where("paragraph_index <= 3").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("paragraph_index", "text"))).alias("_l"))
    base = p.where(i % 3 == 0).select(i.alias("_base"), F.concat(F.lit("X"), "paper_id").alias("_to"))
    edge = lambda relation: F.struct(F.col("_to").alias("target"), F.lit(relation).alias("relation"))
    return p.join(lines, "doc_id", "left").withColumn("_base", i - i % 3).join(base, "_base", "left").select(
        i.alias("seq"),
        F.when(i % 3 == 0, F.concat(F.lit("X"), "paper_id")).alias("candidate"),
        "doi",
        F.concat(F.lit("h"), i.cast("string")).alias("source_hash"),
        "title",
        "year",
        "domain_tags",
        F.col("first_author").alias("author"),
        F.lit("1").alias("processor_version"),
        F.lit(False).alias("force"),
        F.transform(F.slice("_l", 1, 1), lambda x: F.struct(x["text"].alias("claim"), F.lit("conclusion").alias("claim_type"), F.lit("B").alias("strength"))).alias("claims"),
        F.transform("_l", lambda x: F.struct(F.lit(None).cast("string").alias("section"), x["paragraph_index"].cast("string").alias("page"), x["text"].alias("source_text"))).alias("evidence"),
        F.when(i % 3 != 0, F.array(edge("cites"), edge("likes"))).alias("edges"),
    )


@query("""with seen as (select *, doc_id % 3 = 0 or year is not null as sane, trim(title) <> '' as titled from papers),
ok as (select * from seen where sane and titled), l as (select doc_id, count(*) as n from chunks where paragraph_index <= 3 group by 1)
select 'claims' as name, (select count(*) from ok join l using (doc_id))::bigint as n_rows
union all select 'evidence', (select coalesce(sum(n), 0) from ok join l using (doc_id))::bigint
union all select 'papers', (select count(*) from ok)::bigint union all select 'edges', (select count(*) from ok join ok b on b.doc_id = ok.doc_id - ok.doc_id % 3
  where ok.doc_id % 3 <> 0 and not (ok.doc_id % 2 = 0 and ok.doc_id % 3 = 1 and ok.doi is null))::bigint
union all select 'jobs', (select count(*) + count(*) filter (doc_id % 2 = 0) from seen)::bigint
union all select 'counters', (select count(distinct (case when doc_id % 3 = 0 then 'X' else '' end || domain, coalesce(year, 0))) from ok)::bigint""")
def import_counts(spark, sf):
    """Rows of every table after two batches and a replay of the first; the second also updates all papers of the first."""
    tables = ing.library(spark, _folder(spark, "library"))
    rows = _packages(spark, sf)
    first = rows.where("seq % 2 = 0")
    ing.import_packages(first, tables, "first")
    ing.import_packages(rows, tables, "second")
    ing.import_packages(first, tables, "first")
    return tables.counts()
