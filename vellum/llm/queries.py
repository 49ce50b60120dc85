"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import fingerprints, html_text, jaccard_join, mixing, oracles, packing, phrases, prefix_trie, quality_rules, sharding, token_files, toxicity, warc, weak_quality
from vellum.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.grouped(documents(spark, sf_dir), width=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classified(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weak_quality.classified(documents(spark, sf_dir))
    return found.select("doc_id", "posterior", "score", "kept")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compared(documents(spark, sf_dir))
    shown = {c: fingerprints.printable(c) for c in ("fingerprint", "edited_fingerprint")}
    return found.withColumns(shown)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: a row's shard follows from its number, so equal texts need not stay together."""
    return sharding.shard(documents(spark, sf_dir), shards=40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir)).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_weak_quality": op4_weak_quality,
    "op5_token_files": op5_token_files,
    "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing,
    "op8_sharding": op8_sharding,
    "op9_html_text": op9_html_text,
    "op10_quality_rules": op10_quality_rules,
    "op11_warc": op11_warc,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrases": op13_phrases,
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {
    "op1_jaccard_join": oracles.JACCARD_JOIN,
    "op2_mixing": oracles.MIXING,
    "op10_quality_rules": oracles.QUALITY_RULES,
    "op11_warc": oracles.WARC,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_phrases": oracles.PHRASES,
}
