"""Metadata filters, ranking features, candidate selection, query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import scoring as sc
from vellum.functions import text as tx
from vellum.operators import lexical as lx
from vellum.operators.skew import first_per_key, substring_pairs, top_k
from vellum.session import written

FILTERS = ("year_from", "year_to", "domain", "method", "venue")
PAPER_FEATURES = ("paper_id", "year", "venue", "domain_tags", "method_tags")


def _checks() -> dict:
    f = {name: F.col(f"_f_{name}") for name in FILTERS}
    p = {c: F.col(c) for c in PAPER_FEATURES}
    return sc.filter_checks(f, p)


def _filter_cols(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", *[F.col(c).alias(f"_f_{c}") for c in FILTERS])


def has_filters() -> Column:
    out = F.lit(False)
    for c in FILTERS:
        out = out | F.col(c).isNotNull()
    return out


def check_pairs(pairs: DataFrame, queries: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """Add ``passes`` and ``metadata`` to (query_id, paper_id, ...) pairs; without ``papers`` the pairs have their features already."""
    checks = _checks()
    extra = [c for c in PAPER_FEATURES if c != "paper_id"]
    known = pairs.join(_filter_cols(queries), "query_id")
    if papers is not None:
        known = known.join(papers.select(*PAPER_FEATURES), "paper_id")
    return (
        known.withColumn("passes", sc.passes(checks))
        .withColumn("metadata", sc.metadata_match(checks))
        .drop(*[f"_f_{c}" for c in FILTERS], *[c for c in extra if c != "year"])
    )


# ---- filters without lexical evidence ---------------------------------------

_SIGNATURE = ("id_prefix", "domain_tags", "method_tags", "venue", "year")


def _with_signature(papers: DataFrame) -> DataFrame:
    """Papers alike in every filterable attribute share one signature."""
    prefix = F.regexp_extract(F.upper("paper_id"), "^(.*_)[^_]*$", 1)
    return papers.withColumn("id_prefix", prefix).withColumn(
        "signature",
        F.sha2(F.to_json(F.struct("id_prefix", "domain_tags", "method_tags", "venue", "year"), {"ignoreNullFields": "false"}), 256),
    )


def _matching_signatures(filters: DataFrame, signatures: DataFrame) -> DataFrame:
    """(filter_id, signature) pairs meeting every supplied filter.

    Each filter turns into an equi-join on the values it accepts; a signature
    matches when it meets as many filters as the row supplies.
    """
    asked = filters.select(
        "filter_id", sum((F.col(c).isNotNull().cast("int") for c in FILTERS), F.lit(0)).alias("asked")
    )

    def tagged(name: str, column: str) -> DataFrame:
        wanted = filters.where(F.col(name).isNotNull()).select("filter_id", F.col(name).alias("pattern"))
        tags = signatures.select("signature", F.explode(column).alias("text"))
        pairs = substring_pairs(wanted, "pattern", tags, "text")
        return wanted.join(pairs, "pattern").join(tags, "text").select("filter_id", "signature")

    years = signatures.where("year is not null").select("year").distinct()
    span = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()

    def dated(name: str, first, last) -> DataFrame:
        ok = (
            filters.where(F.col(name).isNotNull())
            .select("filter_id", first.alias("a"), last.alias("b"))
            .where("a <= b")
            .select("filter_id", F.explode(F.sequence("a", "b")).alias("year"))
        )
        return ok.join(signatures.select("signature", "year"), "year").select("filter_id", "signature")

    stems = F.split(F.regexp_replace("id_prefix", "_$", ""), "_")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(stems)), lambda n: F.array_join(F.slice(stems, 1, n), "_")
    )
    by_id = (
        filters.where(F.col("domain").isNotNull())
        .select("filter_id", F.upper("domain").alias("stem"))
        .join(signatures.select("signature", F.explode(prefixes).alias("stem")), "stem")
        .select("filter_id", "signature")
    )
    met = (
        dated("year_from", F.greatest(F.col("year_from"), lo), hi).withColumn("f", F.lit("year_from"))
        .unionByName(dated("year_to", lo, F.least(F.col("year_to"), hi)).withColumn("f", F.lit("year_to")))
        .unionByName(by_id.withColumn("f", F.lit("domain")))
        .unionByName(tagged("domain", "domain_tags").withColumn("f", F.lit("domain")))
        .unionByName(tagged("method", "method_tags").withColumn("f", F.lit("method")))
        .unionByName(
            tagged("venue", "venues").withColumn("f", F.lit("venue"))
        )
    )
    return (
        met.groupBy("filter_id", "signature")
        .agg(F.count_distinct("f").alias("met"))
        .join(asked, "filter_id")
        .where("met = asked")
        .select("filter_id", "signature")
    )


def filter_papers(papers: DataFrame, queries: DataFrame, k: int, order: tuple = ("year",)) -> DataFrame:
    """Best ``k`` papers per query that meet all its filters, by ``order`` descending, then id.

    Papers of one signature differ only in the order columns, so each signature
    keeps its best k rows before it meets any filter.
    """
    ranked = _with_signature(papers)
    desc = [F.desc_nulls_last(c) for c in order]
    short = top_k(ranked, ["signature"], [*desc, F.asc("paper_id")], k, "_r")
    signatures = written(
        ranked.select("signature", *_SIGNATURE).dropDuplicates(["signature"]).withColumn("venues", F.array("venue")), "signatures"
    )
    asked = queries.where(has_filters())
    key = F.sha2(F.to_json(F.struct(*FILTERS), {"ignoreNullFields": "false"}), 256)
    filters = written(asked.select(key.alias("filter_id"), *FILTERS).dropDuplicates(["filter_id"]), "filters")
    found = _matching_signatures(filters, signatures).join(short.drop("_r"), "signature")
    best = top_k(found, ["filter_id"], [*desc, F.asc("paper_id")], k, "pos")
    return asked.select("query_id", key.alias("filter_id")).join(best, "filter_id").select(
        "query_id", "paper_id", "year", "pos"
    )


# ---- graph and expansion ------------------------------------------------------


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target_paper").alias("paper_id")).agg(F.count("*").alias("degree"))


def featured(papers: DataFrame, edges: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """Ranking features of every paper as one written table."""
    return written(with_centrality(papers.select(*PAPER_FEATURES), edges, degrees), "features")


def with_centrality(df: DataFrame, edges: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """Add in-degree and its share of the largest in-degree; ``degrees`` are counted from the edges if not given."""
    deg = written(in_degrees(edges) if degrees is None else degrees, "degrees")
    top = deg.agg(F.max("degree").alias("m")).scalar()
    return df.join(deg, "paper_id", "left").withColumn(
        "centrality", sc.centrality(F.col("degree"), F.coalesce(top, F.lit(0)))
    ).withColumn("degree", F.coalesce("degree", F.lit(0)))


def alias_map(concepts: DataFrame) -> DataFrame:
    """alias -> canonical name followed by the children's names; the last concept id wins."""
    names = concepts.select(F.col("concept_id").alias("child"), F.col("canonical_name").alias("child_name"))
    kids = (
        concepts.select("concept_id", F.posexplode("child_concepts").alias("pos", "child"))
        .join(names, "child")
        .groupBy("concept_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "child_name"))).alias("kids"))
    )
    terms = concepts.join(kids, "concept_id", "left").select(
        "concept_id",
        "aliases",
        F.concat(
            F.array("canonical_name"),
            F.coalesce(F.transform("kids", lambda x: x["child_name"]), F.array().cast("array<string>")),
        ).alias("terms"),
    )
    flat = terms.select("concept_id", "terms", F.explode("aliases").alias("alias")).withColumn("alias", F.lower("alias"))
    return first_per_key(flat, ["alias"], [F.desc("concept_id")]).select("alias", "terms")


def expand_queries(queries: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """Canonical terms of every alias that occurs in the query text, distinct and sorted."""
    pairs = substring_pairs(aliases, "alias", queries, text)
    found = (
        pairs.select(F.col("pattern").alias("alias"), F.col("text").alias(text))
        .join(aliases, "alias")
        .select(text, F.explode("terms").alias("term"))
        .groupBy(text)
        .agg(F.array_sort(F.collect_set("term")).alias("expansions"))
    )
    return queries.join(found, text, "left").withColumn(
        "expansions", F.coalesce("expansions", F.array().cast("array<string>"))
    )


def descendants(concepts: DataFrame) -> DataFrame:
    """All (ancestor, descendant, depth) pairs along child links, shortest path.

    Each round walks one link on from the pairs that the round before has found
    for the first time, until none is new; so a diamond or a cycle costs no more
    than its pairs, and no path is too long.
    """
    links = written(
        concepts.select(F.col("concept_id").alias("parent"), F.explode("child_concepts").alias("child")).distinct(), "links"
    )
    fresh = written(links.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth")), "pairs")
    known = fresh
    depth = 1
    while not fresh.isEmpty():
        depth += 1
        further = (
            fresh.join(links, F.col("descendant") == F.col("parent"))
            .select("ancestor", F.col("child").alias("descendant"), F.lit(depth).alias("depth"))
            .distinct()
        )
        fresh = written(further.join(known, ["ancestor", "descendant"], "left_anti").select("ancestor", "descendant", "depth"), "pairs")
        known = known.unionByName(fresh)
    return known.where("ancestor <> descendant")


# ---- candidates and ranking ---------------------------------------------------


def candidates(
    index: lx.TextIndex, papers: DataFrame, queries: DataFrame, edges: DataFrame, k: int, expanded: bool = False, features: DataFrame | None = None
) -> DataFrame:
    """(query_id, paper_id, bm25_norm) by the candidate rule.

    Lexical hits are cut by the filters; a query whose words hit nothing takes all
    filtered papers at score 0, all papers if it has neither text nor filters, and
    the substring fallback if it has text only. Lists without lexical evidence are
    ranked by year and in-degree alone, so each keeps its best ``k``.
    """
    hits = written(
        lx.match_expanded(index, queries) if expanded else lx.match_all(index, lx.query_terms(queries)), "hits"
    )
    lexical = check_pairs(hits, queries, papers).where("passes").select("query_id", "paper_id", "score")
    rest = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    ranked = features if features is not None else featured(papers, edges)
    by_filter = _filtered_at_zero(ranked, rest, k)
    blank = rest.where(~has_filters() & ~tx.has_text(F.col("text")))
    everything = (
        ranked.withColumn("_value", _static_score())
        .orderBy(F.desc("_value"), F.asc("paper_id"))
        .limit(k)
        .select("paper_id", F.lit("all").alias("_g"))
    )
    all_papers = blank.select("query_id", F.lit("all").alias("_g")).join(everything, "_g").select("query_id", "paper_id")
    plain = rest.where(~has_filters() & tx.has_text(F.col("text")))
    by_text = lx.substring_fallback(plain, hits, index.docs, ["paper_id"], _fallback_columns(index)).select("query_id", "paper_id")
    zero = by_filter.unionByName(all_papers).unionByName(by_text).withColumn("score", F.lit(0.0))
    return lx.minmax_positive(lexical.unionByName(zero), ["query_id"]).select("query_id", "paper_id", "bm25_norm")


def _fallback_columns(index: lx.TextIndex) -> list[str]:
    return [c for c in ("title", "one_line_description", "keywords") if c in index.cols]


def _static_score():
    """Score of a paper at BM25 0 up to the constant filter term, which is equal for all."""
    return F.round(
        sc.score_lexical(F.lit(0.0), sc.recency(F.col("year")), F.lit(0.0), F.col("centrality")), lx.SCORE_DIGITS
    )


def _filtered_at_zero(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    scored = ranked.withColumn("static_score", _static_score())
    return filter_papers(scored, queries, k, ("static_score",)).select("query_id", "paper_id")


def rank(cands: DataFrame, papers: DataFrame, queries: DataFrame, edges: DataFrame, k: int, features: DataFrame | None = None) -> DataFrame:
    """Hybrid score of every candidate and the best k per query.

    ``cands`` has bm25_norm and optionally vector_norm (null where a row has no
    vector hit).
    """
    cols = ["query_id", "paper_id", "bm25_norm"]
    if "vector_norm" not in cands.columns:
        cands = cands.withColumn("vector_norm", F.lit(None).cast("double"))
    features = features if features is not None else featured(papers, edges)
    known = check_pairs(cands.select(*cols, "vector_norm"), queries, features).join(features.select("paper_id", "centrality"), "paper_id")
    return best(known, k)


def best(known: DataFrame, k: int) -> DataFrame:
    """Hybrid score and the best k per query of pairs that have both norms, their features and what the filters say."""
    score = sc.score_hybrid(
        F.col("bm25_norm"), F.col("vector_norm"), sc.recency(F.col("year")), F.col("metadata"), F.col("centrality")
    )
    scored = known.withColumn("relevance", F.round(score, lx.SCORE_DIGITS))
    return top_k(scored, ["query_id"], [F.desc("relevance"), F.asc("paper_id")], k).select(
        "query_id", "paper_id", "rank", "relevance", "bm25_norm"
    )


def vector_union(cands: DataFrame, hits: DataFrame) -> DataFrame:
    """Add positive vector hits the lexical pass missed; vector term = score / best score.

    ``hits`` is a top-k list, so the per-query maximum runs over at most k rows.
    """
    best = Window.partitionBy("query_id")
    terms = (
        hits.withColumn("_max", F.max("score").over(best))
        .where("score > 0")
        .select("query_id", "paper_id", (F.col("score") / F.col("_max")).alias("vector_norm"))
        .groupBy("query_id", "paper_id")
        .agg(F.max("vector_norm").alias("vector_norm"))
    )
    return cands.join(terms, ["query_id", "paper_id"], "full").withColumn(
        "bm25_norm", F.coalesce("bm25_norm", F.lit(0.0))
    )
