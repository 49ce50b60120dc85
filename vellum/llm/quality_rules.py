"""Quality rules with adaptive thresholds, with DataFrame operations only.

Fixed cut-offs suit no language or source well. Here each measure of a text is a
whole number; its distribution per language and source is kept in a histogram
with buckets of at most 1/128 relative width. Such sketches merge by adding
counts: those of the sources of a language make that of the language, and those
of all languages the global one, which small groups fall back to. From the
quartiles of the sketch comes an upper limit, quartile plus a multiple of the
spread plus a slack that no clean text passes by chance; a filter joins them.

Defined cases: a null or empty text has no words and fails the base rule; null
languages and sources are groups of their own; an empty table gives an empty
result; repeated rows are judged alike; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import let
from vellum.llm.common import table, words

SYMBOLS = "#*$%&|<>"
SCALE = 10_000
#: Measure -> least distance of the limit from the upper quartile, in units of 1/SCALE.
SLACK = {"symbol_share": 1_000, "dup_line_share": 4_000, "repeat_share": 3_000, "word_length": 40_000}
SPREADS = 4
LEAST_ROWS = 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _windows(w: Column) -> Column:
    """Hash of each three-word window; fewer words have none."""
    return F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )


def _covered(h: Column) -> Column:
    """Words inside windows that occur twice or more: sorted by hash, equal neighbours tell the positions."""
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(ordered: Column) -> Column:
        twice = F.transform(
            ordered,
            lambda x, k: F.when(
                (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]), x["i"]
            ),
        )
        return F.array_sort(F.filter(twice, lambda x: x.isNotNull()))

    def words_in(at: Column) -> Column:
        reach = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda total, x: total + x)

    return let(let(pairs, places), words_in)


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts of each whole text: words, their code points, symbols, repeated lines, words in repeated windows."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, " \t\n\u000b\f\r", "") != "")
    return (
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(lang).alias("lang"),
            F.col(source).alias("source"),
            words(F.col(text)).alias("_w"),
            F.length(F.translate(body, " \t\n\u000b\f\r", "")).cast("bigint").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            lines.alias("_lines"),
        )
        .withColumn("_h", _windows(F.col("_w")))
        .select(
            "doc_id",
            "lang",
            "source",
            F.size("_w").cast("bigint").alias("n_words"),
            "word_chars",
            "n_symbols",
            F.size("_lines").cast("bigint").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
            F.when(F.size(F.array_distinct("_h")) == F.size("_h"), 0).otherwise(_covered(F.col("_h"))).cast("bigint").alias("n_repeat_words"),
        )
    )


def _ratio(top: str, below: str) -> Column:
    return F.expr(f"{top} * {SCALE}L div greatest({below}, 1L)")


def values() -> dict[str, Column]:
    return {
        "symbol_share": _ratio("n_symbols", "word_chars"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeat_share": _ratio("n_repeat_words", "n_words"),
        "word_length": _ratio("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bucket(v: Column) -> Column:
    """Lower end of the bucket: numbers below 256 are exact, larger ones keep eight leading bits."""
    drop = F.greatest(F.length(F.bin(v)) - 8, F.lit(0))
    return F.when(v < 256, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop))


def sketches(measured: DataFrame) -> DataFrame:
    """Histogram rows ``lang, source, measure, bucket, n`` of the rows that pass the base rule."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _bucket(v).alias("bucket")) for k, v in values().items()]))
    return (
        measured.where(~base_failed())
        .select("lang", "source", each.alias("_m"))
        .groupBy("lang", "source", "_m.measure", "_m.bucket")
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    seen = merged.withColumn("_up", F.sum("n").over(w.orderBy("bucket"))).withColumn("_all", F.sum("n").over(w))
    cut = [F.min(F.when(100 * F.col("_up") >= q * F.col("_all"), F.col("bucket"))).alias(f"q{q}") for q in (25, 75)]
    slack = F.coalesce(*[F.when(F.col("measure") == k, F.lit(v)) for k, v in SLACK.items()])
    return (
        seen.groupBy(*keys, "measure")
        .agg(*cut, F.max("_all").alias("rows"))
        .withColumn("most", F.col("q75") + SPREADS * (F.col("q75") - F.col("q25")) + slack)
    )


def limits(sketch: DataFrame) -> DataFrame:
    """One row per language and source with a limit ``most_<measure>`` for each measure."""

    def wide(q: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return q.groupBy(*keys).agg(
            F.max("rows").alias(f"{tag}_rows"),
            *[F.max(F.when(F.col("measure") == k, F.col("most"))).alias(f"{tag}_{k}") for k in SLACK],
        )

    own = wide(_quartiles(sketch, ["lang", "source"]), ["lang", "source"], "own")
    lang = wide(_quartiles(sketch, ["lang"]), ["lang"], "lang").withColumnRenamed("lang", "_l")
    every = wide(_quartiles(sketch, []), [], "all")
    one = F.lit(1)
    joined = (
        own.join(lang, F.col("lang").eqNullSafe(F.col("_l")), "left")
        .withColumn("_one", one)
        .join(every.withColumn("_one", one), "_one", "left")
    )

    def chosen(k: str) -> Column:
        return (
            F.when(F.col("own_rows") >= LEAST_ROWS, F.col(f"own_{k}"))
            .when(F.col("lang_rows") >= LEAST_ROWS, F.col(f"lang_{k}"))
            .otherwise(F.col(f"all_{k}"))
            .alias(f"most_{k}")
        )

    return joined.select("lang", "source", *[chosen(k) for k in SLACK])


def judged(docs: DataFrame, **columns) -> DataFrame:
    """The measures of each row, ``base_failed``, and ``kept``: the base rule passes and no measure is above its limit."""
    measured = table(measures(docs, **columns), "quality-measures")
    limit = limits(sketches(measured)).withColumnRenamed("lang", "_l").withColumnRenamed("source", "_s")
    same = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    fine = F.lit(True)
    for k, v in values().items():
        fine = fine & (v <= F.coalesce(F.col(f"most_{k}"), v))
    return (
        measured.join(limit, same, "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & fine)
        .drop("_l", "_s")
    )
