"""Which paper an incoming package is, and the ids and keys that new papers get.

``resolve_identity`` gives every row of a batch the outcome it would have if the rows came one by
one, in the order of ``seq``: an earlier row may have made the paper that a later one means, taken
its DOI, or freed one. Every outcome depends on earlier rows only. So all rows are judged at once,
against what the last round said of the rows before them, until a round changes nothing: after
``k`` rounds all rows with chains of at most ``k`` are settled, whatever the partitioning. What a
row needs to know of the earlier ones is the largest of something per key, so a round is a few
running maxima that no hot DOI, hash or paper brings into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import keys as ky
from vellum.functions import text as tx
from vellum.operators.skew import number_within, running_max, running_total
from vellum.session import written

#: Later than every row of a batch.
_EVER = (1 << 62) - 1


def default_domain(domain_tags: Column, default: str = "ILT") -> Column:
    """The first domain tag, else the default, in capitals."""
    return F.upper(F.coalesce(tx.blank_to_null(F.try_element_at(domain_tags, F.lit(1))), F.lit(default)))


# ---- the ladder ------------------------------------------------------------------------


def _state(papers: DataFrame) -> DataFrame:
    """Stored papers as rows that come before the batch; their numbers are below 0."""
    some = papers.select(
        F.lit(None).cast("bigint").alias("row"), "paper_id", "doi", "source_hash", tx.title_norm(F.col("title")).alias("title"), "processor_version"
    )
    return some.withColumns({"candidate": F.col("paper_id"), "force": F.lit(True), "entity": F.col("paper_id"), "decision": F.lit("STORED")})


def _until(rows: DataFrame, held: list[str]) -> DataFrame:
    """``seq, entity``, the values held, and in ``until`` the number of the row that writes the same paper next; blocked rows write none."""
    written_rows = rows.where("decision <> 'BLOCKED'").select("seq", "entity", *held, (-F.col("seq")).alias("_back"))
    later = running_max(written_rows, ["entity"], "_back", F.col("_back"), "_next")
    return later.withColumn("until", F.coalesce(-F.col("_next"), F.lit(_EVER))).drop("_back", "_next")


def _holder(rows: DataFrame, holders: DataFrame, key: str, held: str, out: str) -> DataFrame:
    """Who holds the value of ``key`` when a row comes: the paper whose last writing of it still stands.

    Of several holders it is the one that keeps it longest.
    """
    asks = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), (2 * F.col("seq")).alias("_at"), "seq", F.lit(None).cast("struct<until:bigint,entity:string>").alias("_held"))
    has = holders.where(F.col(held).isNotNull()).select(
        F.col(held).alias("_key"), (2 * F.col("seq") + 1).alias("_at"), F.lit(None).cast("bigint").alias("seq"), F.struct("until", "entity").alias("_held")
    )
    found = running_max(asks.unionByName(has), ["_key"], "_at", F.col("_held"), "_last").where(F.col("seq").isNotNull())
    return rows.join(found.where(F.col("_last.until") >= F.col("seq")).select("seq", F.col("_last.entity").alias(out)), "seq", "left")


def _judged(rows: DataFrame, last: DataFrame) -> DataFrame:
    """One round: the outcome of every row of the batch, given that of the round before."""
    holders = written(_until(last, ["_doi", "source_hash"]), "holders")
    made = last.where("decision in ('STORED', 'INSERTED')").groupBy(F.col("entity").alias("candidate")).agg(F.min("seq").alias("_made"))
    found = rows.join(made, "candidate", "left")
    found = _holder(found, holders, "doi", "_doi", "by_doi")
    found = _holder(found, holders, "source_hash", "source_hash", "by_hash")
    known = F.coalesce(F.col("_made") < F.col("seq"), F.lit(False))
    taken = F.col("by_doi").isNotNull()
    repeated = F.col("by_hash").isNotNull()
    decision = F.when(known | taken, F.lit("UPDATED")).when(repeated & ~F.col("force"), F.lit("BLOCKED")).otherwise("INSERTED")
    entity = F.when(known, F.col("candidate")).when(taken, F.col("by_doi")).otherwise(F.coalesce("candidate", F.concat(F.lit("#"), F.col("row").cast("string"))))
    conflict = known & taken & (F.col("by_doi") != F.col("candidate"))
    return found.withColumns({"decision": decision, "entity": entity, "_doi": F.when(~conflict, F.col("doi")), "_known": known}).drop("_made", "row", "doi", "force")


def resolve_identity(incoming: DataFrame, papers: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``seq, decision, target, matched_by, matched_id, warnings, doi`` of every incoming row.

    ``incoming`` has ``seq`` (a unique whole number, at least 0), ``candidate`` (wanted paper id or null),
    ``doi, source_hash, title, processor_version`` and ``force``; ``papers`` are the stored ones. The ladder is:
    a known paper id, a known DOI, a known source hash (``BLOCKED`` unless forced), else ``INSERTED``,
    with a note where a paper has the same title. ``target`` of a new paper without an id is ``#seq``.
    A DOI that belongs to another paper than the id's is nulled. Blank ids, DOIs, hashes and titles are none.

    Rounds end when nothing changes; a chain of ``n`` rows that each depend on the one before takes ``n``,
    and beyond ``most_rounds`` an error says so.
    """
    blank = lambda c: tx.blank_to_null(F.col(c))
    rows = incoming.select(
        F.col("seq").cast("bigint").alias("seq"), F.col("seq").cast("bigint").alias("row"), blank("candidate").alias("candidate"), blank("doi").alias("doi"),
        blank("source_hash").alias("source_hash"), tx.blank_to_null(tx.title_norm(F.col("title"))).alias("title"), "processor_version",
        F.coalesce("force", F.lit(False)).alias("force"),
    )
    rows = written(rows, "incoming")
    old = _state(papers).withColumn("_doi", blank("doi")).withColumn("source_hash", blank("source_hash")).withColumn("title", blank("title"))
    old = written(old.drop("paper_id").withColumn("seq", -1 - F.monotonically_increasing_id()), "stored-papers")
    # titles and versions are long and decide nothing, so the rounds do without
    named = ["title", "processor_version"]
    columns = ["seq", "_doi", "source_hash", "decision", "entity"]
    stored, judged = old.select(*columns), rows.drop(*named)
    last = stored
    before: DataFrame | None = None
    for _ in range(most_rounds):
        now = written(_judged(judged, last), "judged")
        if before is not None:
            both = now.alias("a").join(before.alias("b"), "seq")
            same = F.col("a.decision").eqNullSafe(F.col("b.decision")) & F.col("a.entity").eqNullSafe(F.col("b.entity")) & F.col("a._doi").eqNullSafe(F.col("b._doi"))
            if both.where(~same).isEmpty():
                break
        before, last = now, stored.unionByName(now.select(*columns))
    else:
        raise ValueError(f"some rows depend on chains of more than {most_rounds} earlier rows")
    now = now.join(rows.select("seq", *named), "seq")
    return _explained(now, old.select(*columns, *named).unionByName(now.select(*columns, *named)))


def _explained(now: DataFrame, last: DataFrame) -> DataFrame:
    """Matches and warnings of settled rows."""
    now = _holder(now, _until(last, ["title"]), "title", "title", "by_title")
    writes = last.where("decision <> 'BLOCKED'").select("entity", "seq", "source_hash", "processor_version")
    prior = running_max(writes, ["entity"], "seq", F.struct(F.col("seq").alias("s"), "source_hash", "processor_version"), "prior").where("seq >= 0")
    now = now.join(prior.select("seq", "prior"), "seq", "left")
    known, updated = F.col("_known"), F.col("decision") == "UPDATED"
    repeated = ~updated & F.col("by_hash").isNotNull()
    similar = (F.col("decision") == "INSERTED") & F.col("by_title").isNotNull()
    old_hash, old_version = F.col("prior.source_hash"), F.col("prior.processor_version")
    compared = updated & old_hash.isNotNull() & F.col("source_hash").isNotNull()
    code = lambda when, name: F.when(when, F.lit(name))
    warnings = F.array_compact(
        F.array(
            code(known & F.col("by_doi").isNotNull() & (F.col("by_doi") != F.col("candidate")), "ID_DOI_CONFLICT"),
            code(updated & ~known & F.col("candidate").isNotNull(), "REASSIGNED_ID"),
            code(repeated, "DUPLICATE_SOURCE"),
            code(similar, "POSSIBLE_DUPLICATE"),
            code(compared & (old_hash != F.col("source_hash")), "SOURCE_CHANGED"),
            code(compared & (old_hash == F.col("source_hash")) & ~old_version.eqNullSafe(F.col("processor_version")), "EXTRACTION_UPDATED"),
        )
    )
    by = F.when(known, F.lit("paper_id")).when(updated, "doi").when(repeated, "source_hash").when(similar, "title")
    matched = F.when(updated, F.col("entity")).when(repeated, F.col("by_hash")).when(similar, F.col("by_title"))
    return now.select(
        "seq", "decision", F.when(F.col("decision") != "BLOCKED", F.col("entity")).alias("target"), by.alias("matched_by"), matched.alias("matched_id"),
        warnings.alias("warnings"), F.col("_doi").alias("doi"),
    )


# ---- lookups and edges -----------------------------------------------------------------


def lookup(asked: DataFrame, papers: DataFrame, column: str, by: str) -> DataFrame:
    """``asked`` with ``paper_id`` of the paper whose ``by`` equals the column; the smallest id of several, blank finds none."""
    one = papers.where(F.col(by).isNotNull() & (F.col(by) != "")).groupBy(F.col(by).alias("_by")).agg(F.min("paper_id").alias("paper_id"))
    return asked.join(one, F.col(column) == F.col("_by"), "left").drop("_by")


def resolve_edges(edges: DataFrame, papers: DataFrame, relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges ``source_paper, target_paper, relation`` to stored papers, and those that were left out, with a reason.

    A target is a paper id, else a citation key, else a title; equal edges count once. A relation that is
    not listed leaves the edge out, and so does a target that is not there.
    """
    e = edges.select("source_paper", "target", "relation")
    found = e.join(papers.select(F.col("paper_id").alias("_id")), F.col("target") == F.col("_id"), "left")
    found = lookup(found, papers, "target", "citation_key").withColumnRenamed("paper_id", "_key")
    titled = papers.select("paper_id", tx.title_norm(F.col("title")).alias("_norm"))
    found = lookup(found.withColumn("_t", tx.title_norm(F.col("target"))), titled, "_t", "_norm").withColumnRenamed("paper_id", "_title")
    found = found.withColumn("target_paper", F.coalesce("_id", "_key", "_title"))
    reason = F.when(~F.coalesce(F.col("relation").isin(*relations), F.lit(False)), F.lit("unknown relation")).when(F.col("target_paper").isNull(), F.lit("unresolved target"))
    judged = written(found.withColumn("reason", reason).select("source_paper", "target", "relation", "target_paper", "reason"), "edges")
    kept = judged.where("reason is null").select("source_paper", "target_paper", "relation").distinct()
    return kept, judged.where("reason is not null").select("source_paper", "target", "relation", "reason")


# ---- counters and suffixes -------------------------------------------------------------


def allocate_ids(new: DataFrame, counters: DataFrame, log: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Paper ids for new rows, and the counters after them.

    ``new`` has ``row_key, seq, domain, year``; ``counters`` has ``domain, year, next_value``. Numbers follow
    ``seq`` within a domain and year and continue the counter, so a number is never given again, whether or
    not its paper is still there. A row whose key is in ``log`` (``row_key, paper_id``, of earlier batches)
    keeps that id and moves no counter, so a batch may be replayed. Returns ``row_key, paper_id`` and counters.
    """
    rows = new.select("row_key", "seq", F.upper("domain").alias("domain"), F.col("year").cast("int").alias("year"))
    if log is not None:
        log = log.select("row_key", "paper_id")
        fresh = rows.join(log, "row_key", "left_anti")
        kept = log.join(rows.select("row_key"), "row_key", "left_semi")
    else:
        fresh, kept = rows, None
    fresh = written(number_within(fresh, ["domain", "year"], "seq", "_n"), "new-ids")
    at = counters.select("domain", F.col("year").cast("int").alias("year"), F.col("next_value").cast("bigint").alias("next_value"))
    given = fresh.join(at, ["domain", "year"], "left").withColumn("_value", F.coalesce("next_value", F.lit(1)) + F.col("_n") - 1)
    ids = given.select("row_key", ky.paper_id(F.col("domain"), F.col("year"), F.col("_value")).alias("paper_id"))
    counts = fresh.groupBy("domain", "year").agg(F.count("*").alias("_more"))
    after = at.join(counts, ["domain", "year"], "full").select(
        "domain", "year", (F.coalesce("next_value", F.lit(1)) + F.coalesce("_more", F.lit(0))).alias("next_value")
    )
    return (ids if kept is None else ids.unionByName(kept)), after


def raised(counters: DataFrame, ids: DataFrame) -> DataFrame:
    """Counters that are past every number in ``ids`` (column ``paper_id``) of the form that is given out, so none is given again."""
    part = [F.regexp_extract("paper_id", r"^(.+)_(\d{4})_(\d{3,18})$", i) for i in (1, 2, 3)]
    used = ids.select(part[0].alias("domain"), part[1].alias("year"), part[2].alias("n")).where("domain <> ''")
    used = used.groupBy("domain", F.col("year").cast("int").alias("year")).agg((F.max(F.col("n").cast("bigint")) + 1).alias("_past"))
    return counters.join(used, ["domain", "year"], "full").select("domain", "year", F.greatest("next_value", "_past").alias("next_value"))


def suffixed_keys(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``row_key, citation_key``: the wanted key, with ``_a``, ``_b`` … ``_z``, ``_aa`` … where it is taken.

    ``new`` has ``row_key, seq, base``, ``existing`` has ``citation_key``. Rows get the first free suffixes in the
    order of ``seq``; suffixes that stored keys have are skipped, so two batches give what one would. The
    n-th row of a base takes the n-th free number, which is ``n`` plus the number of taken ones among
    those before it: a running count over both. Wanted keys have no suffix of their own.
    """
    # stored keys: their base and number, once as they are and once with the suffix split off
    parts = [F.regexp_extract("citation_key", "^(.+)_([a-z]+)$", i) for i in (1, 2)]
    plain = existing.select(F.col("citation_key").alias("base"), F.lit(0).cast("bigint").alias("number"))
    ended = existing.select(parts[0].alias("base"), ky.suffix_number(parts[1]).alias("number")).where("base <> ''")
    taken = plain.unionByName(ended).distinct().join(new.select("base").distinct(), "base", "left_semi")
    # the j-th taken number t (from 0) comes after t - j free ones
    taken = number_within(taken, ["base"], "number", "_j").select("base", (F.col("number") - F.col("_j") + 1).alias("_before"))
    taken = taken.groupBy("base", "_before").agg(F.count("*").alias("_taken"))
    rows = number_within(new.select("row_key", "seq", "base"), ["base"], "seq", "_i")
    marks = taken.select("base", (2 * F.col("_before")).alias("_at"), "_taken", F.lit(None).cast("bigint").alias("_i"), F.lit(None).cast(new.schema["row_key"].dataType).alias("row_key"))
    asks = rows.select("base", (2 * F.col("_i") - 1).alias("_at"), F.lit(0).cast("bigint").alias("_taken"), "_i", "row_key")
    counted = running_total(marks.unionByName(asks), ["base"], "_at", "_taken", "_skipped").where(F.col("_i").isNotNull())
    number = F.col("_i") - 1 + F.col("_skipped")
    return counted.select("row_key", F.when(number == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), ky.suffix_letters(number))).alias("citation_key"))
