"""Embedding inputs, embedders, vector search and the embedding table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import blank_to_null, text_or_empty
from vellum.operators.skew import top_k

EMBEDDING_COLS = ("paper_id", "object_type", "object_id", "model", "model_version", "vector")
BLOCK_VECTORS = 1 << 16
BLOCK_QUERIES = 1 << 12


def _dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 when either has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, _dot(a, b) / size).otherwise(F.lit(0.0))


def _block_top_k(k: int) -> Callable:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Vectors on the left, queries on the right: cosine of one block pair."""
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "paper_id": [], "object_id": [], "score": []})
        left = left.sort_values(["paper_id", "object_id"], kind="stable")
        m = np.stack(left["vector"].to_numpy()).astype(np.float64)
        q = np.stack(right["query_vector"].to_numpy()).astype(np.float64)
        size = np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        sims = np.divide(m @ q.T, size, out=np.zeros_like(size), where=size > 0).round(9)
        keep = np.argsort(-sims, axis=0, kind="stable")[:k]
        n = keep.shape[0]
        flat = keep.T.ravel()
        return pd.DataFrame(
            {
                "query_id": np.repeat(right["query_id"].to_numpy(), n),
                "paper_id": left["paper_id"].to_numpy()[flat],
                "object_id": left["object_id"].to_numpy()[flat],
                "score": np.take_along_axis(sims, keep, axis=0).T.ravel(),
            }
        )

    return run


def vector_topk(
    queries: DataFrame, embeddings: DataFrame, k: int = 10,
    block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Exact cosine top k of every query inside its object type.

    ``queries`` has query_id (long), object_type and query_vector. Vectors and
    queries are cut into blocks of bounded size; each pair of blocks is one
    matrix product that returns only its local top k, and a window merges them.
    Neither side is collected, broadcast or grouped as a whole.
    """
    n_vec = embeddings.groupBy("object_type").agg(F.ceil(F.count("*") / block_vectors).cast("bigint").alias("n_vb"))
    n_qry = queries.groupBy("object_type").agg(F.ceil(F.count("*") / block_queries).cast("bigint").alias("n_qb"))
    grid = n_vec.join(n_qry, "object_type")
    left = (
        embeddings.select("object_type", "paper_id", "object_id", "vector")
        .join(grid, "object_type")
        .withColumn("vb", F.pmod(F.xxhash64("paper_id", "object_id"), F.col("n_vb")))
        .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_qb") - 1)))
        .drop("n_vb", "n_qb")
    )
    right = (
        queries.select("object_type", "query_id", "query_vector")
        .join(grid, "object_type")
        .withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("n_qb")))
        .withColumn("vb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_vb") - 1)))
        .drop("n_vb", "n_qb")
    )
    # fresh column identities: queries are often a selection of the same table
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    keys = ["object_type", "vb", "qb"]
    local = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(_block_top_k(k), "query_id long, paper_id string, object_id string, score double")
    )
    return top_k(local, ["query_id"], [F.desc("score"), F.asc("paper_id"), F.asc("object_id")], k)


def embedding_inputs(papers: DataFrame, evidence: DataFrame | None = None, formulas: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """(paper_id, object_type, object_id, text) of everything that gets a vector."""
    words = F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")
    l0 = F.concat_ws(
        " ", blank_to_null(F.col("title")), blank_to_null(F.col("one_line_description")), blank_to_null(words)
    )
    out = papers.select("paper_id", F.lit("paper").alias("object_type"), F.lit("L0").alias("object_id"), l0.alias("text")).where("text <> ''")

    def part(df: DataFrame, kind: str, oid: str, text: Column) -> DataFrame:
        return df.select("paper_id", F.lit(kind).alias("object_type"), F.col(oid).alias("object_id"), text.alias("text"))

    if evidence is not None:
        out = out.unionByName(part(evidence, "evidence", "evidence_id", F.col("source_text")))
    if formulas is not None:
        text = F.concat(F.col("formula_latex"), F.lit(" "), text_or_empty("semantic_description"))
        out = out.unionByName(part(formulas, "formula", "formula_id", text))
    if chunks is not None:
        out = out.unionByName(part(chunks, "chunk", "chunk_id", F.col("text")))
    return out


def token_presence(c: Column, vocabulary: Sequence[str]) -> Column:
    """Deterministic 0/1 vector: does the text contain each word, any case."""
    low = F.lower(text_or_empty(c))
    return F.array(*[(F.instr(low, w.lower()) > 0).cast("float") for w in vocabulary])


def embed(df: DataFrame, fn: Callable[[Sequence[str]], np.ndarray], text: str = "text", out: str = "vector") -> DataFrame:
    """Apply a user-supplied embedder (list of texts -> 2-d array) to a column, batch by batch."""

    def run(batches):
        for pdf in batches:
            vectors = np.asarray(fn(pdf[text].fillna("").tolist()), dtype=np.float32)
            yield pdf.assign(**{out: [row.tolist() for row in vectors]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{out}` array<float>")


def store_embeddings(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the vectors of every (paper, object type) that has new ones."""
    touched = new.select("paper_id", "object_type").distinct()
    return embeddings.join(touched, ["paper_id", "object_type"], "left_anti").unionByName(new, allowMissingColumns=True)
