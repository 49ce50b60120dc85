"""Inverted index, boolean and phrase search, BM25, score normalisation.

Postings are built inside each row (sort the tokens, count the runs), so an
ad-hoc search over an unindexed corpus needs no shuffle before the query terms
have filtered the postings. A persisted index is the same DataFrame written
with ``bucketBy("term")``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum import vocab
from vellum.functions import text as tx
from vellum.operators import in_row
from vellum.operators.skew import containing, top_k
from vellum.session import written

IN_ROW_TERMS = 100_000  # query terms that are sent to every row of an index
SCORE_DIGITS = 9  # float sums differ in the last bits between partitionings


@dataclass(frozen=True)
class TextIndex:
    """Postings (ids, term, tf, dl), one stats row (n_docs, avg_len) and the source columns.

    ``freq`` (term, df) is there where document frequencies are kept; else they are counted from the postings.
    ``rows`` has one row per document: its ids, all its columns, and its distinct ``terms``, their ``tfs`` and its ``dl``.
    """

    postings: DataFrame
    stats: DataFrame
    docs: DataFrame
    ids: tuple[str, ...]
    cols: tuple[str, ...]
    freq: DataFrame | None = None
    rows: DataFrame | None = None


def _joined(c: str, df: DataFrame) -> Column:
    """Array columns are indexed element by element."""
    if df.schema[c].dataType.typeName() == "array":
        return F.array_join(F.col(c), " ")
    return F.col(c)


def _all_tokens(df: DataFrame, cols: Sequence[str]) -> Column:
    return F.flatten(F.array(*[tx.index_tokens(_joined(c, df)) for c in cols]))


def _runs(tokens: Column) -> Column:
    """Tokens -> array of (term, tf, dl), by sorting and counting equal neighbours."""

    def starts(t: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(t) - 1),
            lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)),
        )

    def count(t: Column, s: Column) -> Column:
        return F.transform(
            s,
            lambda at, j: F.struct(
                F.get(t, at).alias("term"),
                (F.coalesce(F.get(s, j + 1), F.size(t)) - at).alias("tf"),
                F.size(t).alias("dl"),
            ),
        )

    runs = tx.let(F.sort_array(tokens), lambda t: tx.let(starts(t), lambda s: count(t, s)))
    return runs


def term_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add each row's distinct ``terms``, how often it has each (``tfs``) and its length (``dl``)."""
    tokens = _all_tokens(df, cols)
    runs = df.withColumn("_runs", F.when(F.size(tokens) > 0, _runs(tokens)).otherwise(F.array().cast("array<struct<term:string,tf:int,dl:int>>")))
    length = F.coalesce(F.get("_runs.dl", 0), F.lit(0))
    return runs.withColumns({"terms": F.col("_runs.term"), "tfs": F.col("_runs.tf"), "dl": length}).drop("_runs")


def _index_of(rows: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> TextIndex:
    postings = rows.select(*ids, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("_p")).select(*ids, "_p.terms", "_p.tfs", "dl")
    stats = rows.select(F.col("dl").cast("bigint").alias("dl")).agg(
        F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"), F.sum("dl").alias("n_tokens")
    )
    return TextIndex(postings.toDF(*ids, "term", "tf", "dl"), stats, rows.select(*ids, *cols), tuple(ids), tuple(cols), None, rows)


def build_index(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> TextIndex:
    """Index the given text or array columns of ``df``."""
    return _index_of(term_rows(df, cols), ids, cols)


def persisted(index: TextIndex) -> TextIndex:
    """The index as one written table, so that a search reads terms instead of texts and the rows are made once."""
    kept = _index_of(written(index.rows, "index"), index.ids, index.cols)
    return replace(kept, stats=written(kept.stats, "index-stats"))


def positions(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Positional postings: one row per token with its column and 1-based position."""
    per_col = F.array(
        *[
            F.struct(F.lit(c).alias("col"), tx.index_tokens(_joined(c, df)).alias("tokens"))
            for c in cols
        ]
    )
    return (
        df.select(*ids, F.explode(per_col).alias("_c"))
        .select(*ids, F.col("_c.col").alias("col"), F.posexplode("_c.tokens").alias("pos", "term"))
        .withColumn("pos", F.col("pos") + 1)
    )


def sync_postings(postings: DataFrame, new: DataFrame, key: str = "paper_id", touched: DataFrame | None = None) -> DataFrame:
    """Replace all postings of the touched papers by the new ones."""
    touched = (touched if touched is not None else new).select(key).distinct()
    return postings.join(touched, key, "left_anti").unionByName(new)


# ---- queries -------------------------------------------------------------


def query_terms(queries: DataFrame, text: str = "text", tokens: Column | None = None) -> DataFrame:
    """Distinct terms per query with their repeat count; queries without terms drop out."""
    tokens = tx.search_terms(F.col(text)) if tokens is None else tokens
    return (
        queries.select("query_id", F.explode(tokens).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def _idf(n: Column, df: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(vocab.IDF_FLOOR))


def _saturated(tf: Column, dl: Column, avg_len: Column) -> Column:
    k1, b = vocab.BM25_K1, vocab.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_len))


def weigh_terms(index: TextIndex, terms: DataFrame) -> DataFrame:
    """Add document frequency, inverse document frequency and collection stats to query terms."""
    wanted = terms.select("term").distinct()
    if index.freq is not None:
        freq = index.freq.join(wanted, "term", "left_semi")
    else:
        freq = index.postings.select("term").join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return (
        terms.join(freq, "term", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumn("n_docs", index.stats.select("n_docs").scalar())
        .withColumn("avg_len", index.stats.select("avg_len").scalar())
        .withColumn("idf", _idf(F.col("n_docs"), F.col("df")))
    )


def _contribution() -> Column:
    return F.col("qtf") * F.col("idf") * _saturated(F.col("tf"), F.col("dl"), F.col("avg_len"))


def _total() -> Column:
    return F.round(F.sum(_contribution()), SCORE_DIGITS).alias("score")


def _few(index: TextIndex, weighed: DataFrame) -> bool:
    """The index has its rows, and the query terms are few enough to be sent to each of them."""
    return index.rows is not None and weighed.count() <= IN_ROW_TERMS


def _plan(weighed: DataFrame) -> DataFrame:
    """query_id with its terms and their words."""
    plan = weighed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("df", "term", "qtf", "idf", "avg_len"))).alias("needed"))
    return plan.withColumn("words", F.col("needed.term"))


def _in_row_score() -> Column:
    """BM25 of a row's ``terms`` and ``tfs`` for the terms that are ``needed``."""

    def part(x: Column) -> Column:
        at = (F.array_position("terms", x["term"]) - 1).cast("int")
        return x["qtf"] * x["idf"] * _saturated(F.coalesce(F.get("tfs", at), F.lit(0)), F.col("dl"), x["avg_len"])

    return F.round(F.aggregate("needed", F.lit(0.0), lambda acc, x: acc + part(x)), SCORE_DIGITS)


def match_all(index: TextIndex, terms: DataFrame) -> DataFrame:
    """Documents holding every term of a query, with BM25; see :func:`_all_by_postings`.

    If the query terms are few, each document with a query's rarest term looks for the others in its own row.
    """
    weighed = written(weigh_terms(index, terms), "terms")
    if not _few(index, weighed):
        return _all_by_postings(index, weighed)
    # the first word is the rarest; a query with an unknown term has no answer
    plan = _plan(weighed).where(F.get("needed.df", 0) > 0)
    keys = plan.select("query_id", "needed", "words", F.get("words", 0).alias("_term"))
    rows = index.rows.select(*index.ids, "terms", "tfs", "dl", F.explode("terms").alias("_term"))
    found = rows.join(F.broadcast(keys), "_term").where(F.size(F.array_except("words", "terms")) == 0)
    return found.select("query_id", *index.ids, _in_row_score().alias("score"))


def match_any(index: TextIndex, terms: DataFrame, k: int | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Documents holding at least one term of a query, with BM25 and the columns in ``also``; see :func:`_any_by_postings`.

    With ``k`` at least the best k of each query and their equals. If the query terms are few, each document is scored
    in its own row, and tasks keep their own best. ``matched``, the number of met terms, may be asked for as well.
    """
    ids, more = list(index.ids), [c for c in also if c != "matched"]
    weighed = written(weigh_terms(index, terms).where("df > 0"), "terms")
    if _few(index, weighed):
        hits = in_row.scored(index.rows, weighed.withColumn("weight", F.col("qtf") * F.col("idf")), [*ids, *more], k)
        hits = hits.withColumn("score", F.round("score", SCORE_DIGITS))
        if k is not None:
            by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
            hits = hits.withColumn("_rank", F.rank().over(by_score)).where(F.col("_rank") <= k)
        return hits.select("query_id", *ids, "score", *also)
    hits = _any_by_postings(index, weighed, k)
    if "matched" in also:
        words = index.postings.join(weighed.select("query_id", "term"), "term").groupBy("query_id", *ids).agg(F.count("*").cast("int").alias("matched"))
        hits = hits.join(words, ["query_id", *ids])
    if more:
        hits = hits.join(index.rows.select(*ids, *more), ids)
    return hits.select("query_id", *ids, "score", *also)


def _all_by_postings(index: TextIndex, weighed: DataFrame) -> DataFrame:
    """Documents holding every term of a query, with BM25.

    Each query starts from its rarest term; its other terms are looked up by
    (document, term). Frequent terms therefore never fan out on their own key.
    Seeds are written, so that their size is known before postings are moved.
    """
    ids = list(index.ids)
    plan = weighed.groupBy("query_id").agg(
        F.min_by("term", F.struct("df", "term")).alias("seed"),
        F.min("df").alias("min_df"),
        F.count("*").alias("n_terms"),
        F.collect_list(F.struct("term", "qtf", "idf", "avg_len")).alias("needed"),
    )
    plan = written(plan.where("min_df > 0").select("query_id", "seed", "n_terms", "needed"), "plan")
    seeds = written(index.postings.select(*ids, F.col("term").alias("seed")).join(plan, "seed").select("query_id", *ids), "seeds")
    needed = plan.select("query_id", "n_terms", F.inline("needed"))
    # only postings of wanted terms can be looked up
    postings = index.postings.join(weighed.select("term").distinct(), "term", "left_semi")
    found = seeds.join(needed, "query_id").join(postings, [*ids, "term"])
    return (
        found.groupBy("query_id", *ids)
        .agg(_total(), F.count("*").alias("_n"), F.first("n_terms").alias("n_terms"))
        .where("_n = n_terms")
        .select("query_id", *ids, "score")
    )


def _any_by_postings(index: TextIndex, weighed: DataFrame, k: int | None) -> DataFrame:
    """Documents holding at least one term of a query, with BM25.

    With ``k`` only the best k per query are needed. Terms found in half of all
    documents or more carry the floor weight; they can lift a document by at most
    ``sum(qtf * floor * (k1 + 1))``. So queries whose k-th best document, scored
    on the other terms, beats that bound do not have to walk the frequent
    postings: only documents within the bound of the k-th score are completed
    with them. All other queries take the full walk, so the result is exact.
    """
    ids = list(index.ids)
    cols = ["query_id", "term", "qtf", "idf", "avg_len"]
    weak = F.col("idf") <= vocab.IDF_FLOOR
    if k is None:
        return index.postings.join(weighed.select(*cols), "term").groupBy("query_id", *ids).agg(_total())
    bound = weighed.groupBy("query_id").agg(
        F.sum(F.when(weak, F.col("qtf") * F.col("idf") * (vocab.BM25_K1 + 1)).otherwise(F.lit(0.0))).alias("lift")
    )
    strong = (
        index.postings.join(weighed.where(~weak).select(*cols), "term")
        .groupBy("query_id", *ids)
        .agg(F.sum(_contribution()).alias("part"))
    )
    kth = (
        top_k(strong, ["query_id"], [F.desc("part")], k)
        .groupBy("query_id")
        .agg(F.min("part").alias("kth"), F.count("*").alias("n"))
        .join(bound, "query_id")
        .where((F.col("n") == k) & (F.col("kth") > F.col("lift")))
        # scores are rounded and tied by id, so keep what is within half a digit as well
        .select("query_id", (F.col("kth") - F.col("lift") - 10.0**-SCORE_DIGITS).alias("at_least"))
    )
    close = strong.join(kth, "query_id").where(F.col("part") >= F.col("at_least"))
    lifted = (
        close.select("query_id", *ids)
        .join(weighed.where(weak).select(*cols), "query_id")
        .join(index.postings, [*ids, "term"])
        .select("query_id", *ids, _contribution().alias("part"))
    )
    full = (
        index.postings.join(weighed.join(kth, "query_id", "left_anti").select(*cols), "term")
        .select("query_id", *ids, _contribution().alias("part"))
    )
    return (
        close.select("query_id", *ids, "part")
        .unionByName(lifted)
        .unionByName(full)
        .groupBy("query_id", *ids)
        .agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))
    )


def best(hits: DataFrame, ids: Sequence[str], k: int) -> DataFrame:
    """Best-first top k per query, ties by id."""
    return top_k(hits, ["query_id"], [F.desc("score"), *[F.asc(c) for c in ids]], k)


# ---- phrases -------------------------------------------------------------


def match_phrases(index: TextIndex, phrases: DataFrame) -> DataFrame:
    """Occurrences of each phrase per document; a phrase may not span columns.

    ``phrases`` has phrase_id and text. Each place of a phrase's rarest token is looked at in the text around it,
    so a text is cut into tokens twice however many phrases it may hold. Tokens and their places are not stored.
    """
    ids = list(index.ids)
    tokens = tx.index_tokens(F.col("text"))
    p = phrases.select("phrase_id", tokens.alias("tokens")).where(F.size("tokens") > 0)
    words = written(p.select("phrase_id", "tokens", F.explode(F.array_distinct("tokens")).alias("term")), "phrase-words")
    texts = F.array(*[tx.index_tokens(_joined(c, index.docs)) for c in index.cols])
    columns = index.docs.select(*ids, texts.alias("_cols"))
    dl = F.aggregate("_cols", F.lit(0), lambda acc, x: acc + F.size(x))
    columns = columns.select(*ids, dl.alias("dl"), F.explode("_cols").alias("_col"))
    spread = columns.select(F.explode("_col").alias("term")).join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    rarest = (
        words.join(spread, "term")
        .groupBy("phrase_id")
        .agg(F.min_by(F.struct("term", "tokens"), F.struct("n", "term")).alias("w"))
        .select("phrase_id", F.col("w.term").alias("term"), F.col("w.tokens").alias("tokens"))
        .withColumn("_before", F.array_position("tokens", F.col("term")).cast("int") - 1)
    )
    places = columns.select(*ids, "dl", "_col", F.posexplode("_col").alias("_pos", "term"))
    from_ = F.col("_pos") - F.col("_before")
    return (
        places.join(written(rarest, "phrases"), "term")
        .where((from_ >= 0) & (F.slice("_col", F.greatest(from_, F.lit(0)) + 1, F.size("tokens")) == F.col("tokens")))
        .groupBy("phrase_id", *ids, "dl")
        .agg(F.count("*").cast("int").alias("tf"))
        .select("phrase_id", *ids, "tf", "dl")
    )


def score_phrases(index: TextIndex, phrases: DataFrame) -> DataFrame:
    """BM25 of each phrase, treated as one term."""
    hits = match_phrases(index, phrases)
    freq = hits.groupBy("phrase_id").agg(F.count("*").alias("df"))
    return (
        hits.join(freq, "phrase_id")
        .withColumn("n_docs", index.stats.select("n_docs").scalar())
        .withColumn("avg_len", index.stats.select("avg_len").scalar())
        .withColumn("part", _idf(F.col("n_docs"), F.col("df")) * _saturated(F.col("tf"), F.col("dl"), F.col("avg_len")))
        .select("phrase_id", *index.ids, "part")
    )


def match_expanded(index: TextIndex, queries: DataFrame, text: str = "text", expansions: str = "expansions", digits: int = SCORE_DIGITS) -> DataFrame:
    """(all terms) OR (any expansion phrase); only satisfied branches score. The sum is rounded once, to ``digits``."""
    ids = list(index.ids)
    literal = match_all(index, query_terms(queries, text))
    wanted = queries.select("query_id", F.explode(expansions).alias("text"))
    distinct = wanted.select(F.col("text").alias("phrase_id"), "text").distinct()
    by_phrase = (
        wanted.select("query_id", F.col("text").alias("phrase_id"))
        .join(score_phrases(index, distinct), "phrase_id")
        .select("query_id", *ids, F.col("part").alias("score"))
    )
    return (
        literal.unionByName(by_phrase)
        .groupBy("query_id", *ids)
        .agg(F.round(F.sum("score"), digits).alias("score"))
    )


# ---- fallback and normalisation --------------------------------------------


def substring_fallback(queries: DataFrame, hits: DataFrame, docs: DataFrame, ids: Sequence[str], cols: Sequence[str], text: str = "text") -> DataFrame:
    """Literal, case-insensitive containment for queries the index did not answer (score 0)."""
    open_queries = (
        queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
        .where(tx.has_text(F.col(text)))
        .select("query_id", F.col(text).alias("pattern"))
    )
    open_queries = written(open_queries, "open-queries")
    if open_queries.isEmpty():  # no text is looked at
        return open_queries.select("query_id").join(docs.select(*ids).limit(0), F.lit(True)).withColumn("score", F.lit(0.0))
    return substring_hits(open_queries, docs, ids, cols)


def substring_hits(patterns: DataFrame, docs: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows that hold a query's ``pattern`` in one of the columns, any case (score 0)."""
    if unknown := set(cols) - set(docs.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    parts = F.array(
        *[
            F.col(c) if docs.schema[c].dataType.typeName() != "array" else F.to_json(c)
            for c in cols
        ]
    )
    cells = docs.select(*ids, F.explode(parts).alias("text")).where(F.col("text").isNotNull())
    return (
        patterns.join(containing(patterns, "pattern", cells, "text"), "pattern")
        .select("query_id", *ids)
        .distinct()
        .withColumn("score", F.lit(0.0))
    )


def minmax(df: DataFrame, by: Sequence[str], score: str = "score", out: str = "relevance") -> DataFrame:
    """Min-max per group, equal values become 1. The range is aggregated map-side."""
    span = df.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return (
        df.join(span, list(by))
        .withColumn(
            out,
            F.when(F.col("_lo") == F.col("_hi"), F.lit(1.0)).otherwise(
                (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
            ),
        )
        .drop("_lo", "_hi")
    )


def minmax_positive(df: DataFrame, by: Sequence[str], score: str = "score", out: str = "bm25_norm") -> DataFrame:
    """Min-max over positive scores only; others become 0, a single value becomes 1."""
    span = (
        df.where(F.col(score) > 0)
        .groupBy(*by)
        .agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    )
    return (
        df.join(span, list(by), "left")
        .withColumn(
            out,
            F.when(F.coalesce(F.col(score), F.lit(0.0)) <= 0, F.lit(0.0))
            .when(F.col("_lo") == F.col("_hi"), F.lit(1.0))
            .otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))),
        )
        .drop("_lo", "_hi")
    )
