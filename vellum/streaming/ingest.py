"""Imports into a table set: whole packages, and changes that arrive as a stream.

``import_packages`` settles a batch of packages as if they came one by one (identity, ids, citation
keys) and publishes papers and all their child rows at once, with a row of the job log for each package.
``apply_changes`` keeps the latest version of every key; ``follow`` does so for a stream of files, a
micro-batch at a time. The name of a batch goes into the manifest with its rows, so a batch that a
restarted stream sends again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vellum import vocab
from vellum.functions import keys as ky
from vellum.operators import identity as idn
from vellum.operators.skew import first_per_key
from vellum.session import written
from vellum.sources.tableset import TableSet

CHILDREN = {"claims": ("claim_id", "claim"), "evidence": ("evidence_id", "evidence")}


# ---- packages -----------------------------------------------------------------------------


def library(spark: SparkSession, root: str) -> TableSet:
    """The table set of a library: children go with their paper, edges with their source, or with either end if that is deleted."""
    keys = {"papers": ("paper_id",), "claims": ("paper_id",), "evidence": ("paper_id",), "edges": ("source_paper",), "counters": ("counter",), "jobs": ()}
    return TableSet(spark, root, keys, {"edges": ("source_paper", "target_paper")})


def _stored(tables: TableSet, name: str, schema: str) -> DataFrame:
    if any(r.name == name for r in tables.segments()):
        return tables.read(name)
    return tables.spark.createDataFrame([], schema)


PAPERS = (
    "paper_id string, domain string, year int, title string, author string, doi string, source_hash string, processor_version string, citation_key string, created_in string, updated_in string"
)


def import_packages(packages: DataFrame, tables: TableSet, batch_name: str, default_domain: str = "ILT") -> int:
    """Import a batch; returns the version that has it.

    ``packages`` has ``seq, candidate, doi, source_hash, title, year, domain_tags, author, processor_version, force`` and
    ``claims`` (array of ``claim, claim_type, strength``), ``evidence`` (array of ``section, page, source_text``) and ``edges``
    (array of ``target, relation``), any of them null. Of several packages that settle on one paper the last gives its
    rows. A package without a title, or a new one without id and year, is rejected. A citation key stays with its paper.
    Ids that packages bring along move the counters, so no number is given twice. A new paper keeps the batch it came in as ``created_in``. Every package has a row in ``jobs``.
    """
    if batch_name in tables.batches():
        return tables.version()
    papers = written(_stored(tables, "papers", PAPERS), "papers")
    rows = written(packages, "packages")
    titled = F.coalesce(F.trim("title") != "", F.lit(False))
    sane = rows.where(titled & (F.col("candidate").isNotNull() | F.col("year").isNotNull()))
    settled = written(idn.resolve_identity(sane, papers), "settled")
    fresh = settled.where("decision = 'INSERTED' and target like '#%'").select("seq").join(rows, "seq")
    wanted = fresh.select(F.col("seq").cast("string").alias("row_key"), "seq", idn.default_domain(F.col("domain_tags"), default_domain).alias("domain"), "year")
    counters = _stored(tables, "counters", "counter string, domain string, year int, next_value bigint")
    used = papers.select("paper_id").unionByName(settled.where("target not like '#%'").select(F.col("target").alias("paper_id")))
    counters = written(idn.raised(counters.select("domain", "year", "next_value"), used), "counters")
    ids, counters_after = idn.allocate_ids(wanted, counters)
    names = written(ids.select(F.concat(F.lit("#"), "row_key").alias("target"), F.col("paper_id").alias("_new")), "new-names")
    settled = settled.join(names, "target", "left").withColumn("paper_id", F.coalesce("_new", "target")).drop("_new")
    settled = written(settled, "named")
    accepted = settled.where("decision <> 'BLOCKED'").select("seq", "paper_id", F.col("doi").alias("_doi"))
    last = first_per_key(accepted, ["paper_id"], [F.col("seq").desc()])
    whole = written(last.join(rows.drop("doi"), "seq").withColumnRenamed("_doi", "doi"), "accepted")

    old = papers.select("paper_id", F.col("citation_key").alias("_key"), F.col("created_in").alias("_created"))
    base = whole.join(old, "paper_id", "left")
    new_keys = base.where("_key is null").select(
        F.col("paper_id").alias("row_key"), "seq", ky.citation_key(F.col("title"), F.col("year"), F.col("author")).alias("base")
    )
    keyed = idn.suffixed_keys(new_keys, papers.where("citation_key is not null").select("citation_key"))
    base = base.join(keyed.select(F.col("row_key").alias("paper_id"), "citation_key"), "paper_id", "left")
    now = F.lit(batch_name)
    paper_rows = base.select(
        "paper_id", idn.default_domain(F.col("domain_tags"), default_domain).alias("domain"), F.col("year").cast("int").alias("year"), "title", "author", "doi", "source_hash",
        "processor_version", F.coalesce("_key", "citation_key").alias("citation_key"), F.coalesce("_created", now).alias("created_in"), now.alias("updated_in"),
    )
    paper_rows = written(paper_rows, "paper-rows")
    known = papers.select("paper_id", "citation_key", "title").join(paper_rows.select("paper_id"), "paper_id", "left_anti").unionByName(paper_rows.select("paper_id", "citation_key", "title"))
    edges = whole.select(F.col("paper_id").alias("source_paper"), F.inline("edges"))
    kept, left = idn.resolve_edges(edges, known, list(vocab.RELATIONS))
    out = {"papers": paper_rows, "edges": kept}
    for name, (key, kind) in CHILDREN.items():
        items = whole.select("paper_id", F.posexplode(name).alias("_i", "_c"))
        out[name] = items.select(ky.sub_id(F.col("paper_id"), kind, F.col("_i") + 1).alias(key), "paper_id", "_c.*")
    dropped = left.groupBy(F.col("source_paper").alias("paper_id")).agg(F.count("*").alias("edges_left_out"))
    jobs = rows.select("seq", F.when(~titled, "no title").when(F.col("candidate").isNull() & F.col("year").isNull(), "no year to number it by").alias("reason"))
    jobs = jobs.join(settled.select("seq", "decision", "paper_id", "warnings"), "seq", "left").join(dropped, "paper_id", "left")
    out["jobs"] = jobs.select(
        now.alias("batch_name"), "seq", F.coalesce("decision", F.lit("REJECTED")).alias("decision"), F.when(F.col("decision") != "BLOCKED", F.col("paper_id")).alias("paper_id"),
        F.array_join("warnings", ",").alias("warnings"), "reason", F.coalesce("edges_left_out", F.lit(0)).alias("edges_left_out"),
    )
    touched = counters_after.withColumn("counter", F.concat_ws("/", "domain", F.col("year").cast("string"))).select("counter", "domain", "year", "next_value")
    out["counters"] = touched
    gone = paper_rows.select(F.col("paper_id").alias("id")).unionByName(touched.select(F.col("counter").alias("id")))
    return tables.publish(batch_name, out, replaced=gone)


# ---- changes ------------------------------------------------------------------------------


def apply_changes(changes: DataFrame, tables: TableSet, batch_name: str, key: str, version: Sequence[str], is_delete: Column, child: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Keep the latest version of every key: table ``items``, child rows in ``parts``, and ``versions`` of all keys ever seen.

    Of the changes of a key in a batch the one with the largest ``version`` columns counts, and only if it is later than
    the stored one, so late and repeated changes don't matter. A deletion takes the key's rows out and leaves its version,
    against changes that come after it but are older. Changes without a key are none.
    """
    if batch_name in tables.batches():
        return tables.version()
    at = F.struct(*version)
    marked = changes.where(F.col(key).isNotNull()).withColumn("_deleted", F.coalesce(is_delete, F.lit(False)))
    latest = first_per_key(marked, [key], [at.desc()])
    if any(r.name == "versions" for r in tables.segments()):
        had = tables.read("versions").select(F.col(key).alias("_k"), F.struct(*version).alias("_had"))
        latest = latest.join(had, F.col(key) == F.col("_k"), "left").where(F.col("_had").isNull() | (at > F.col("_had"))).drop("_k", "_had")
    latest = written(latest, "latest")
    rows = latest.where(~F.col("_deleted")).drop("_deleted")
    out = {"items": rows, "versions": latest.select(key, *version, F.col("_deleted").alias("deleted"))}
    if child is not None:
        out["parts"] = child(rows)
    return tables.publish(batch_name, out, replaced=latest.select(F.col(key).alias("id")))


def changing(spark: SparkSession, root: str, key: str) -> TableSet:
    return TableSet(spark, root, {"items": (key,), "versions": (key,), "parts": (key,)})


def follow(
    spark: SparkSession, source: str, schema: StructType, tables: TableSet, checkpoint: str, key: str, version: Sequence[str], is_delete: Column,
    child: Callable[[DataFrame], DataFrame] | None = None, files: int = 1, name: str = "stream",
) -> StreamingQuery:
    """Apply all Parquet files of a folder that the checkpoint hasn't, ``files`` at a time, then stop; call again for more."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def apply(rows: DataFrame, number: int) -> None:
        apply_changes(rows, tables, f"{name}-{number}", key, version, is_delete, child)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
