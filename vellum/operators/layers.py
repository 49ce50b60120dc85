"""Layered retrieval: every function answers a whole table of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum import vocab
from vellum.functions import render as rd
from vellum.functions import text as tx
from vellum.operators import lexical as lx
from vellum.operators import rank as rk
from vellum.operators import vector as vc
from vellum.operators.skew import first_per_key, substring_pairs, top_k
from vellum.session import written

PAPER_INDEX_COLS = ("title", "keywords", "domain_tags", "method_tags", "one_line_description")
RESULT_COLS = (
    "query_id", "mode", "rank", "paper_id", "title", "relevance", "best_use", "key_fact", "citation_key",
    "citation", "available_levels", "evidence_ids", "token_cost", "truncated", "next_action",
)


@dataclass(frozen=True)
class Corpus:
    """The tables a query may touch. Optional ones may be absent."""

    papers: DataFrame
    edges: DataFrame
    cards: DataFrame | None = None
    metrics: DataFrame | None = None
    comparisons: DataFrame | None = None
    claims: DataFrame | None = None
    evidence: DataFrame | None = None
    formulas: DataFrame | None = None
    variables: DataFrame | None = None
    chunks: DataFrame | None = None
    concepts: DataFrame | None = None
    ontology: DataFrame | None = None
    records: DataFrame | None = None
    embeddings: DataFrame | None = None
    #: In-degrees (``paper_id, degree``) where they need not be counted from the edges.
    degrees: DataFrame | None = None
    #: Another column of ``papers`` that names them, the metrics by it before papers are looked up, and
    #: the tables' rows of given papers (that column and ``paper_id``).
    key: str = "paper_id"
    keyed_metrics: DataFrame | None = None
    rows_of: Callable[[DataFrame], dict[str, DataFrame]] | None = None
    kept: dict = field(default_factory=dict, repr=False, compare=False)

    def _index(self, name: str, df: DataFrame, ids: list[str], cols: tuple[str, ...]) -> lx.TextIndex:
        """An index is written at its first use and kept with this corpus, whose tables don't change."""
        if name not in self.kept:
            self.kept[name] = lx.persisted(lx.build_index(df, ids, cols))
        return self.kept[name]

    def paper_index(self) -> lx.TextIndex:
        return self._index("papers", self.papers, ["paper_id"], PAPER_INDEX_COLS)

    def evidence_index(self) -> lx.TextIndex:
        return self._index("evidence", self.evidence, ["paper_id", "evidence_id"], ("source_text", "claim", "section"))

    def formula_index(self) -> lx.TextIndex:
        return self._index("formulas", self.formulas, ["paper_id", "formula_id"], ("formula_latex", "semantic_description", "variables"))

    def chunk_index(self) -> lx.TextIndex:
        return self._index("chunks", self.chunks, ["paper_id", "chunk_id"], ("text", "section"))

    def features(self) -> DataFrame:
        """Ranking features of all papers, written once."""
        if "features" not in self.kept:
            self.kept["features"] = rk.featured(self.papers, self.edges, self.degrees)
        return self.kept["features"]

    def of(self, wanted: DataFrame) -> Corpus:
        """The rows of the ``wanted`` papers, a short written list. The other papers' rows are left where they are read."""
        papers = self.papers.join(wanted.select("paper_id").distinct(), "paper_id", "left_semi")
        ids = written(papers.select(*dict.fromkeys(("paper_id", self.key))), "wanted")
        known = self.rows_of(ids) if self.rows_of else {}
        few = {
            name: known[name] if name in known else table.join(ids.select("paper_id"), "paper_id", "left_semi")
            for name in ("cards", "metrics", "comparisons", "evidence", "formulas", "chunks")
            if (table := getattr(self, name)) is not None
        }
        return replace(self, papers=papers, keyed_metrics=None, rows_of=None, kept={}, **few)


def _citation() -> Column:
    return rd.short_citation(F.col("bibliographic_record"), F.col("authors_summary"), F.col("year"))


def _strings() -> Column:
    return F.array().cast("array<string>")


# ---- routing, budget, hints ----------------------------------------------------


def route(queries: DataFrame) -> DataFrame:
    """Add mode, start layer, escalation, budget and cap; unknown intents get a null mode.

    The optional column ``max_tokens`` overrides the default budget.
    """
    hit = F.filter(rd.route_rows(), lambda r: r["mode"] == F.upper("intent"))
    plan = F.try_element_at(hit, F.lit(1))
    given = F.col("max_tokens") if "max_tokens" in queries.columns else F.lit(None).cast("int")
    return queries.select(
        "*",
        plan["mode"].alias("mode"),
        plan["start_layer"].alias("start_layer"),
        plan["escalation"].alias("escalation"),
        F.coalesce(given, plan["budget"]).alias("budget"),
        plan["cap"].alias("cap"),
    )


def next_action(start_layer: Column, escalation: Column, has_results: Column) -> Column:
    """Hint to the next layer when there are results and the intent may escalate."""
    out = F.lit("")
    for layer, nxt, hint in vocab.NEXT_LAYERS:
        out = F.when(
            has_results & (start_layer == layer) & F.array_contains(escalation, nxt), F.lit(hint)
        ).otherwise(out)
    return out


def cut_to_budget(items: DataFrame, budget: str = "budget", order: tuple[str, ...] = ("paper_id",)) -> DataFrame:
    """Keep the best items whose running cost fits the budget.

    Items dearer than the whole budget are skipped; the first overflow ends the
    list. Costs are at least 1, so the running-sum test is the same as stopping.
    ``items`` are ranked lists, at most one result cap per query.
    """
    w = Window.partitionBy("query_id")
    by_rank = w.orderBy(F.desc("relevance"), *[F.asc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.col(budget) > 0) & (F.col("token_cost") <= F.col(budget))
    spent = F.sum(F.when(fits, F.col("token_cost"))).over(by_rank)
    marked = items.withColumn("_kept", fits & (F.coalesce(spent, F.lit(0)) <= F.col(budget)))
    return (
        marked.withColumn("truncated", F.count("*").over(w) > F.count(F.when(F.col("_kept"), 1)).over(w))
        .where("_kept")
        .drop("_kept")
    )


# ---- paper facts -----------------------------------------------------------------


def available_levels(corpus: Corpus, wanted: DataFrame | None = None) -> DataFrame:
    """paper_id -> levels in order L0, L1, L2, L3, L4, FORMULA; one shuffle for all tables."""
    names = ("L0", "L1", "L2", "L3", "L4", "FORMULA")
    tables = (corpus.papers, corpus.cards, corpus.metrics, corpus.evidence, corpus.chunks, corpus.formulas)
    seen = None
    for i, df in enumerate(tables):
        if df is None:
            continue
        ids = df.select("paper_id", F.lit(i).alias("level"))
        seen = ids if seen is None else seen.unionByName(ids)
    if wanted is not None:
        seen = seen.join(wanted.select("paper_id").distinct(), "paper_id", "left_semi")
    flags = [F.max((F.col("level") == i).cast("int")).alias(f"_l{i}") for i in range(len(names))]
    levels = F.array_compact(F.array(*[F.when(F.col(f"_l{i}") == 1, F.lit(n)) for i, n in enumerate(names)]))
    return seen.groupBy("paper_id").agg(*flags).where("_l0 = 1").select("paper_id", levels.alias("available_levels"))


def evidence_ids(evidence: DataFrame, n: int = 3, wanted: DataFrame | None = None) -> DataFrame:
    """paper_id -> its first ``n`` evidence ids."""
    e = evidence.select("paper_id", "evidence_id")
    if wanted is not None:
        e = e.join(wanted.select("paper_id").distinct(), "paper_id", "left_semi")
    firsts = top_k(e, ["paper_id"], [F.asc("evidence_id")], n)
    return firsts.groupBy("paper_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))


def assemble(ranked: DataFrame, corpus: Corpus, mode: str, key_fact: Column | None = None, best_use: str = "") -> DataFrame:
    """Ranked (query_id, paper_id, rank, relevance) rows -> result items.

    The ranked lists, a few rows per query, are written first: papers, levels and
    evidence are each looked up from them.
    """
    ranked = written(ranked, "ranked")
    fact = F.col("one_line_description") if key_fact is None else key_fact
    carried = [c for c in ranked.columns if c.startswith("fact_")]
    base = ranked.select("query_id", "paper_id", "rank", "relevance", *carried)
    items = (
        base.join(corpus.papers, "paper_id")
        .withColumn("key_fact", tx.text_or_empty(fact))
        .select(
            "query_id", F.lit(mode).alias("mode"), "rank", "paper_id",
            tx.text_or_empty("title").alias("title"), "relevance", F.lit(best_use).alias("best_use"), "key_fact",
            tx.text_or_empty("citation_key").alias("citation_key"), _citation().alias("citation"),
            (tx.estimate_tokens(F.col("key_fact")) + 20).alias("token_cost"),
        )
    )
    few = corpus.of(ranked)
    items = items.join(available_levels(few), "paper_id", "left")
    if few.evidence is None:
        return items.withColumn("evidence_ids", _strings())
    return items.join(evidence_ids(few.evidence, 3), "paper_id", "left").withColumn(
        "evidence_ids", F.coalesce("evidence_ids", _strings())
    )


# ---- L0, L1, L2 --------------------------------------------------------------------


def rank_papers(queries: DataFrame, corpus: Corpus, k: int, query_vectors: DataFrame | None = None, index: lx.TextIndex | None = None) -> DataFrame:
    """Candidates, optional vector union, hybrid score, top k."""
    expanded = corpus.concepts is not None
    if expanded:
        queries = rk.expand_queries(queries, rk.alias_map(corpus.concepts))
    index, features = index or corpus.paper_index(), corpus.features()
    if query_vectors is None or corpus.embeddings is None:
        cands = rk.candidates(index, corpus.papers, queries, corpus.edges, k, expanded, features)
        return rk.rank(cands, corpus.papers, queries, corpus.edges, k, features)
    typed = query_vectors.withColumn("object_type", F.lit("paper"))
    hits = written(vc.vector_topk(typed, corpus.embeddings, k), "vector-hits")
    # a vector hit may fall below papers without one; at most k rows have a hit, so k more are enough
    cands = rk.candidates(index, corpus.papers, queries, corpus.edges, 2 * k, expanded, features)
    cands = rk.vector_union(cands, rk.check_pairs(hits, queries, corpus.papers).where("passes"))
    return rk.rank(cands, corpus.papers, queries, corpus.edges, k, features)


def discover(queries: DataFrame, corpus: Corpus, k: int = 10, query_vectors: DataFrame | None = None) -> DataFrame:
    return assemble(rank_papers(queries, corpus, k, query_vectors), corpus, "DISCOVERY")


def technical(queries: DataFrame, corpus: Corpus, k: int = 5) -> DataFrame:
    """Like discovery, with the method summary (else main idea, else abstract) as key fact."""
    facts = corpus.cards.select(
        "paper_id",
        F.coalesce(*[tx.blank_to_null(F.col(c)) for c in ("method_summary", "main_idea", "abstract")]).alias("fact_summary"),
    )
    ranked = rank_papers(queries, corpus, k).join(facts, "paper_id", "left")
    return assemble(ranked, corpus, "TECHNICAL", F.col("fact_summary"))


def matching_metrics(queries: DataFrame, metrics: DataFrame) -> DataFrame:
    """First metric per (query, paper) whose name, condition or text value contains the query.

    A paper's metrics with equal cells are answered by the first of them, so the metrics are read once and
    only those firsts meet the queries. Containment is decided on distinct cell values, then joined back by equality.
    """
    cells = F.array("name", "_cond", "value_text")
    row = F.struct("metric_id", "name", "value", "value_text", "unit", "condition")
    m = metrics.withColumn("_cond", F.to_json("condition"))
    firsts = m.groupBy("paper_id", cells.alias("_cells")).agg(F.min_by(row, F.col("metric_id")).alias("m"))
    firsts = written(firsts, "first-metrics")
    q = queries.select("query_id", F.col("text").alias("pattern"))
    pairs = q.join(substring_pairs(q, "pattern", firsts.select(F.explode("_cells").alias("text")).distinct(), "text"), "pattern")
    pairs = written(pairs.select("query_id", F.col("text").alias("cell")), "metric-cells")
    found = firsts.select("paper_id", "m", F.explode(F.array_distinct("_cells")).alias("cell")).join(pairs, "cell")
    return found.groupBy("query_id", "paper_id").agg(F.min_by("m", F.col("m.metric_id")).alias("m")).select("query_id", "paper_id", "m.*")


_CELLS = ("name", "_cond", "value_text")


def _asked(queries: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct query texts with their place, a word and a bit in it, and the words of bits of all cells that contain some."""
    places = queries.select(F.col("text").alias("pattern")).where("pattern is not null").distinct()
    places = written(places.withColumn("_no", F.monotonically_increasing_id()), "patterns").select(
        "pattern", F.floor(F.col("_no") / 64).cast("bigint").alias("word"), (F.col("_no") % 64).cast("int").alias("bit")
    )
    rows = written(cells.distinct(), "cells")
    held = substring_pairs(places, "pattern", rows.select(F.explode(F.array(*_CELLS)).alias("text")), "text").join(places, "pattern")
    found = rows.withColumn("text", F.explode(F.array_distinct(F.array(*_CELLS)))).join(held.select("text", "word", _bit(F.col("bit")).alias("bits")), "text")
    return places, written(found.groupBy(*_CELLS, "word").agg(F.bit_or("bits").alias("bits")), "metric-cells")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def papers_with_metrics(queries: DataFrame, corpus: Corpus) -> DataFrame:
    """``query_id, paper_id`` and the features of every paper with a metric that contains the query.

    Which texts the metrics of a paper contain is one row of bits for each 64 texts, whatever the number of
    metrics; papers and queries come to these rows, and the metrics themselves aren't moved.
    """
    metrics, key = (corpus.metrics, "paper_id") if corpus.keyed_metrics is None else (corpus.keyed_metrics, corpus.key)
    cells = metrics.select(key, "name", F.to_json("condition").alias("_cond"), "value_text")
    places, held = _asked(queries, cells.drop(key))
    same = [cells[c].eqNullSafe(held[c]) for c in _CELLS]
    bits = cells.join(held, same).groupBy(cells[key], "word").agg(F.bit_or("bits").alias("bits"))
    if key != "paper_id":
        bits = bits.join(corpus.papers.select(key, "paper_id").hint("merge"), key).select("paper_id", "word", "bits")
    known = bits.join(corpus.features().hint("merge"), "paper_id")
    is_set = lambda i: F.col("bits").bitwiseAND(_bit(i)) != 0
    found = known.withColumn("bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), is_set))).drop("bits")
    asked = queries.select("query_id", F.col("text").alias("pattern")).join(places, "pattern").drop("pattern").distinct()
    found = found.join(asked, ["word", "bit"]).drop("word", "bit")
    once = asked.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()  # else a paper may be found by two texts
    return found if once else found.dropDuplicates(["query_id", "paper_id"])


def results(queries: DataFrame, corpus: Corpus, k: int = 10, mode: str = "RESULT") -> DataFrame:
    """Papers with a matching metric, rendered; the lexical term is 0.

    A paper's place depends on its features and not on which metric matches, so the first metric is looked
    for in the papers of the lists only.
    """
    allowed = rk.check_pairs(papers_with_metrics(queries, corpus), queries).where("passes")
    best = written(rk.best(allowed.withColumn("bm25_norm", F.lit(0.0)).withColumn("vector_norm", F.lit(None).cast("double")), k), "best")
    found = matching_metrics(queries, corpus.of(best).metrics)
    shown = rd.format_metric(*[F.col(c) for c in ("name", "value", "value_text", "unit", "condition")])
    ranked = best.join(found.select("query_id", "paper_id", shown.alias("fact_metric")), ["query_id", "paper_id"])
    return assemble(ranked, corpus, mode, F.col("fact_metric"), "structured results")


def comparisons(queries: DataFrame, corpus: Corpus, k: int = 10) -> DataFrame:
    """The result list plus the papers' comparison rows with their validity."""
    found = written(results(queries, corpus, k, "COMPARISON"), "compared")
    # the lists are short, so only their papers' rows are moved
    rows = corpus.of(found).comparisons.select(
        "paper_id", "comparison_id", "metric", "baseline", "proposed", "improvement", "comparison_validity"
    )
    return found.join(rows, "paper_id", "left")


# ---- L3, L4, formulas -----------------------------------------------------------------


def _restrict(hits: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Queries listed in ``allowed`` (query_id, paper_id) keep only those papers."""
    if allowed is None:
        return hits
    limited = allowed.select("query_id").distinct().withColumn("_limited", F.lit(True))
    ok = allowed.select("query_id", "paper_id").distinct().withColumn("_ok", F.lit(True))
    return (
        hits.join(limited, "query_id", "left").join(ok, ["query_id", "paper_id"], "left")
        .where(F.col("_limited").isNull() | F.col("_ok")).drop("_limited", "_ok")
    )


def search_evidence(queries: DataFrame, corpus: Corpus, k: int = 10, any_term: bool = False, terms: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Evidence rows best-first with relevance in [0, 1]; paper limits apply before the cut."""
    index = corpus.evidence_index()
    terms = lx.query_terms(queries) if terms is None else terms
    ids = ["paper_id", "evidence_id"]
    if any_term:
        hits = lx.match_any(index, terms, k if allowed is None else None)
    else:
        hits = lx.match_all(index, terms)
    hits = written(hits, "hits")
    fallback = lx.substring_fallback(queries, hits, index.docs, ids, ["source_text", "claim"])
    hits = _restrict(hits.unionByName(fallback), allowed)
    # the lists are short and written, so the texts are read where the index has them and not moved
    short = lx.minmax(written(lx.best(hits, ["evidence_id"], k), "best"), ["query_id"])
    return short.join(index.rows.select("evidence_id", "source_text", "section", "page", "claim"), "evidence_id")


def verify_claims(claims: DataFrame, corpus: Corpus, k: int = 10, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one verdict row per claim, qualified evidence rows).

    ``claims`` has query_id and text. A hit qualifies when at least half of the
    claim's significant tokens occur in its text.
    """
    c = claims.select("query_id", "text", tx.significant_tokens(F.col("text")).alias("tokens"))
    terms = lx.query_terms(c, tokens=F.transform("tokens", lambda t: t))
    hits = search_evidence(c.where(F.size("tokens") > 0), corpus, k, any_term=True, terms=terms, allowed=allowed)
    body = F.lower(F.concat(tx.text_or_empty("source_text"), F.lit(" "), tx.text_or_empty("claim")))
    covered = F.size(F.filter("tokens", lambda t: F.instr(F.col("_body"), t) > 0))
    qualified = (
        hits.join(c.select("query_id", "tokens"), "query_id")
        .withColumn("_body", body)
        .withColumn("coverage", covered / F.size("tokens"))
        .where("coverage >= 0.5")
        .drop("_body")
    )
    qualified = written(qualified, "qualified")
    support = qualified.groupBy("query_id").agg(F.count("*").alias("n_evidence"))
    strength = claim_strength(qualified.select("query_id", "paper_id", "tokens"), corpus.claims)
    verdicts = (
        c.join(support, "query_id", "left").join(strength, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("n_evidence") > 0, "supported").otherwise("unverified").alias("verdict"),
            "strength",
            F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
            F.when(F.size("tokens") == 0, "no significant tokens")
            .when(F.col("n_evidence").isNull(), "no evidence covering the claim's content")
            .otherwise("").alias("note"),
        )
    )
    return verdicts, qualified.drop("tokens")


def claim_strength(support: DataFrame, stored: DataFrame) -> DataFrame:
    """Best stored strength (A first) among supporting papers' claims sharing a token."""
    pairs = support.select("query_id", "paper_id", "tokens").dropDuplicates(["query_id", "paper_id"])
    low = F.lower(tx.text_or_empty("claim"))
    return (
        pairs.join(stored.select("paper_id", "claim", "strength").where(F.col("strength").isin(*vocab.STRENGTHS)), "paper_id")
        .where(F.exists("tokens", lambda t: F.instr(low, t) > 0))
        .groupBy("query_id")
        .agg(F.min("strength").alias("strength"))
    )


def search_formulas(queries: DataFrame, corpus: Corpus, k: int = 10) -> DataFrame:
    """Formulas best-first; an optional query column ``role`` filters before the cut."""
    ids = ["paper_id", "formula_id"]
    index = corpus.formula_index()
    hits = written(lx.match_all(index, lx.query_terms(queries)), "hits")
    fallback = lx.substring_fallback(queries, hits, index.docs, ids, ["formula_latex", "semantic_description"])
    cols = corpus.formulas.select("formula_id", "formula_latex", "formula_role", "semantic_description", "source_evidence_id")
    found = hits.unionByName(fallback).join(cols, "formula_id")
    if "role" in queries.columns:
        roles = queries.select("query_id", F.col("role").alias("_role"))
        found = found.join(roles, "query_id").where(
            F.col("_role").isNull() | (F.col("formula_role") == F.col("_role"))
        ).drop("_role")
    short = lx.minmax(lx.best(found, ["formula_id"], k), ["query_id"])
    if corpus.variables is None:
        return short
    v = corpus.variables.join(short.select("formula_id").distinct(), "formula_id", "left_semi")
    v = v.groupBy("formula_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "symbol", "meaning", "unit"))),
            lambda x: F.struct(x["symbol"].alias("symbol"), x["meaning"].alias("meaning"), x["unit"].alias("unit")),
        ).alias("variables")
    )
    return short.join(v, "formula_id", "left")


def search_chunks(queries: DataFrame, corpus: Corpus, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """Full-text paragraphs holding all query words, with their section as best use."""
    index = corpus.chunk_index()
    hits = _restrict(lx.match_all(index, lx.query_terms(queries)), allowed)
    short = lx.minmax(written(lx.best(hits, ["chunk_id"], k), "best"), ["query_id"])
    use = F.when(tx.has_text(F.col("section")), F.concat(F.lit("L4 chunk · "), F.col("section"))).otherwise("L4 chunk")
    return (
        short.join(index.rows.select("chunk_id", "text", "section"), "chunk_id")
        .join(corpus.papers.select("paper_id", "title", "citation_key"), "paper_id", "left")
        .select(
            "query_id", "rank", "paper_id", "chunk_id", tx.text_or_empty("title").alias("title"), "relevance",
            use.alias("best_use"), tx.text_or_empty("text").alias("key_fact"),
            tx.text_or_empty("citation_key").alias("citation_key"), tx.estimate_tokens(F.col("text")).alias("token_cost"),
        )
    )


# ---- citations and listings ---------------------------------------------------------


def exact_papers(queries: DataFrame, papers: DataFrame) -> DataFrame:
    """(query_id, paper_id, stage) by citation key, else doi, else paper id."""
    found = None
    for stage, key in enumerate(("citation_key", "doi", "paper_id")):
        part = papers.select(F.col(key).alias("text"), F.col("paper_id")).join(queries.select("query_id", "text"), "text")
        part = part.select("query_id", "paper_id", F.lit(stage).alias("stage"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("query_id").agg(
        F.min_by("paper_id", F.struct("stage", "paper_id")).alias("paper_id"), F.min("stage").alias("stage")
    )


def resolve_citation_query(queries: DataFrame, corpus: Corpus) -> DataFrame:
    """One paper per query by key, doi, id, else the best discovery hit without filters."""
    exact = exact_papers(queries, corpus.papers)
    rest = queries.join(exact, "query_id", "left_anti")
    bare = rest.select("query_id", "text", *[F.lit(None).cast("int" if c.startswith("year") else "string").alias(c) for c in rk.FILTERS])
    plain = Corpus(corpus.papers, corpus.edges, degrees=corpus.degrees)
    best = rank_papers(bare, plain, 1).select("query_id", "paper_id", F.lit(3).alias("stage"))
    picked = exact.unionByName(best)
    out = picked.join(
        corpus.papers.select("paper_id", "title", "one_line_description", "citation_key", "bibliographic_record", "authors_summary", "year"),
        "paper_id",
    ).select(
        "query_id", "paper_id", "stage", tx.text_or_empty("title").alias("title"), F.lit(1.0).alias("relevance"),
        tx.text_or_empty("one_line_description").alias("key_fact"), tx.text_or_empty("citation_key").alias("citation_key"),
        _citation().alias("citation"),
    )
    if corpus.evidence is None:
        return out.withColumn("evidence_ids", _strings())
    return out.join(evidence_ids(corpus.evidence, 3, picked), "paper_id", "left").withColumn(
        "evidence_ids", F.coalesce("evidence_ids", _strings())
    )


def cards(ids: DataFrame, corpus: Corpus) -> DataFrame:
    """Full L1 cards with the paper title."""
    wanted = ids.select("paper_id").distinct()
    titles = corpus.papers.select("paper_id", tx.text_or_empty("title").alias("title"))
    return corpus.cards.join(wanted, "paper_id", "left_semi").join(titles, "paper_id", "left").withColumn(
        "title", tx.text_or_empty("title")
    )


def structured(ids: DataFrame, corpus: Corpus, names: DataFrame | None = None) -> DataFrame:
    """Metrics of the papers with ontology rules by exact name; comparisons via ``corpus.comparisons``.

    ``names`` (name) limits the metrics.
    """
    m = corpus.metrics.join(ids.select("paper_id").distinct(), "paper_id", "left_semi")
    if names is not None:
        m = m.join(names.select("name").distinct(), "name", "left_semi")
    rules = corpus.ontology.select(
        F.col("metric_name").alias("name"), tx.blank_to_null(F.col("comparability_rules")).alias("comparability_rules"),
        tx.blank_to_null(F.col("common_pitfalls")).alias("common_pitfalls"),
    )
    return m.join(rules, "name", "left")


def comparison_rows(ids: DataFrame, corpus: Corpus) -> DataFrame:
    return corpus.comparisons.join(ids.select("paper_id").distinct(), "paper_id", "left_semi")


def list_papers(papers: DataFrame, domain: str | None = None, year: int | None = None) -> DataFrame:
    """Papers of a domain and/or year in id order."""
    out = papers.select("paper_id", "title", "year", "venue", "citation_key", "doi", "source_hash")
    if domain:
        out = out.where(F.startswith("paper_id", F.lit(domain.upper() + "_")))
    if year is not None:
        out = out.where(F.col("year") == year)
    return out.orderBy("paper_id")


def cite(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """(paper_id, style_id) -> stored record, else the bundled author-date form, else the minimal form."""
    records = corpus.records.select(
        "paper_id", "style_id", F.col("citation_key").alias("_key"), F.col("in_text_citation").alias("_text"),
        F.col("bibliography_entry").alias("_entry"), F.lit(True).alias("_stored"),
    )
    p = corpus.papers.select("paper_id", "citation_key", "title", "year", "doi", "bibliographic_record", "authors_summary")
    stored = F.coalesce("_stored", F.lit(False))
    styled = (~stored) & (F.col("style_id") == "author-date") & tx.has_text(
        F.coalesce(tx.blank_to_null(F.col("bibliographic_record.title")), F.col("title"))
    )
    family = F.try_element_at("bibliographic_record.authors", F.lit(1))["family"]
    in_text = F.concat(
        F.lit("("),
        F.concat_ws(", ", F.coalesce(tx.blank_to_null(family), F.col("title")), F.when(F.col("year") != 0, F.col("year").cast("string"))),
        F.lit(")"),
    )
    entry = rd.reference_line(F.col("bibliographic_record"), F.col("title"), F.col("year"), F.col("doi"))
    return (
        pairs.join(p, "paper_id").join(records, ["paper_id", "style_id"], "left")
        .select(
            "paper_id", "style_id", F.when(stored, F.col("_key")).otherwise(F.col("citation_key")).alias("citation_key"),
            F.when(stored, F.col("_text")).when(styled, in_text).otherwise(_citation()).alias("in_text_citation"),
            F.when(stored, F.col("_entry")).when(styled, entry).alias("bibliography_entry"),
            F.when(stored, "cache").when(styled, "style").otherwise("minimal").alias("renderer"),
            (~stored & ~F.coalesce(styled, F.lit(False))).alias("generated"),
        )
    )


def csl_items(papers: DataFrame) -> DataFrame:
    """Papers as CSL-JSON-shaped structs; papers without a title drop out."""
    cols = {c: F.col(c) for c in ("paper_id", "citation_key", "title", "year", "doi", "article_type", "bibliographic_record")}
    return papers.select("paper_id", rd.csl_item(cols).alias("item")).where("item is not null")


def bibliography(papers: DataFrame) -> DataFrame:
    """Author-date reference lines in line order."""
    line = rd.reference_line(F.col("bibliographic_record"), F.col("title"), F.col("year"), F.col("doi"))
    return papers.select("paper_id", line.alias("entry")).orderBy("entry", "paper_id")


def topics(sections: DataFrame) -> DataFrame:
    """Distinct non-empty hints and key points per section, in order."""
    both = F.array_distinct(F.filter(F.concat("citations_hint", "key_points"), lambda t: t != ""))
    return sections.select("section_id", F.posexplode(both).alias("topic_pos", "text"))


def once_per_title(cards_found: DataFrame, by: list[str]) -> DataFrame:
    """Each title once per section list: the first topic, then the best rank, keeps it."""
    return first_per_key(cards_found, [*by, "title"], [F.asc("topic_pos"), F.asc("rank")])
