"""Checks and repairs of manuscripts: citation commands, labels, bibliographies, review rounds.

``sections`` has ``manuscript_id, name, body``, ``bibliography`` has ``manuscript_id, key``. All are tables of
many manuscripts; a section is the largest thing that is ever put together in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.skew import first_per_key
from vellum.session import written

#: The commands' forms and the verdicts.
CITE = r"\\cite[a-zA-Z]*\{[^}]*\}"
LABEL = r"\\label\{([^}]*)\}"
VERDICTS = ("ready", "almost", "not ready")


def _commands(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(CITE), F.lit(0))


def _keys(command: Column) -> Column:
    """Keys of one command in order, repeated ones kept."""
    inside = F.regexp_extract(command, r"\{([^}]*)\}", 1)
    return F.filter(F.transform(F.split(inside, ","), lambda k: F.regexp_replace(k, r"(?U)^\s+|\s+$", "")), lambda k: k != "")


def cited_keys(sections: DataFrame) -> DataFrame:
    """``manuscript_id, key``, each once."""
    keys = F.flatten(F.transform(_commands(tx.text_or_empty("body")), _keys))
    return sections.select("manuscript_id", F.explode(keys).alias("key")).distinct()


def sanitize(sections: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections whose citation commands have allowed keys only, and what was dropped.

    A command without an allowed key goes. Returns ``manuscript_id, name, body`` and, in the order in which
    they stood, ``manuscript_id, name, place, key``. Keys are looked up by manuscript and key, so a manuscript
    that many sections or keys belong to is spread by its keys; null bodies are empty.
    """
    rows = sections.select("manuscript_id", "name", tx.text_or_empty("body").alias("body"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "sections")
    commands = rows.select("_row", "manuscript_id", "name", F.posexplode(_commands(F.col("body"))).alias("at", "command"))
    keys = commands.select("_row", "manuscript_id", "name", "at", F.split("command", r"\{")[0].alias("prefix"), F.posexplode_outer(_keys(F.col("command"))).alias("k", "key"))
    known = allowed.select("manuscript_id", "key").distinct().withColumn("_ok", F.lit(True))
    judged = written(keys.join(known, ["manuscript_id", "key"], "left"), "cited")
    kept = F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("k", "key"))))
    new = judged.groupBy("_row", "at").agg(F.first("prefix").alias("prefix"), F.transform(kept, lambda x: x["key"]).alias("keys"))
    new = new.select("_row", "at", F.when(F.size("keys") > 0, F.concat("prefix", F.lit("{"), F.array_join("keys", ","), F.lit("}"))).otherwise("").alias("command"))
    new = new.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "command"))), lambda x: x["command"]).alias("_new"))
    literal = F.split("body", CITE, -1)
    mixed = F.zip_with(literal, F.coalesce("_new", F.array().cast("array<string>")), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    clean = rows.join(new, "_row", "left").select("manuscript_id", "name", F.array_join(mixed, "").alias("body"))
    dropped = judged.where(F.col("_ok").isNull() & F.col("key").isNotNull())
    # a place is that of the command and of the key in it
    return clean, dropped.select("manuscript_id", "name", (F.col("at") * 1_000_000 + F.col("k")).cast("bigint").alias("place"), "key")


def duplicate_labels(sections: DataFrame) -> DataFrame:
    """``manuscript_id, label, n`` of labels that a manuscript has more than once."""
    labels = F.regexp_extract_all(tx.text_or_empty("body"), F.lit(LABEL), F.lit(1))
    return sections.select("manuscript_id", F.explode(labels).alias("label")).groupBy("manuscript_id", "label").agg(F.count("*").alias("n")).where("n > 1")


def citation_gaps(sections: DataFrame, bibliography: DataFrame) -> DataFrame:
    """``manuscript_id, key, gap``: cited without an entry (``missing``), or an entry that is never cited (``orphan``)."""
    cited, listed = written(cited_keys(sections), "cited"), bibliography.select("manuscript_id", "key").distinct()
    both = ["manuscript_id", "key"]
    missing = cited.join(listed, both, "left_anti").withColumn("gap", F.lit("missing"))
    return missing.unionByName(listed.join(cited, both, "left_anti").withColumn("gap", F.lit("orphan")))


# ---- reviews ---------------------------------------------------------------------------


def verdict(text: Column, literal: bool = False) -> Column:
    """``ready``, ``almost`` or ``not ready``. With ``literal`` every text with the word ready is ready, "not ready" too."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(VERDICTS[2]))))
    ready = low.contains("ready") if literal else low.contains("ready") & ~low.rlike(r"\bnot\b[a-z ]*\bready\b")
    return F.when(ready, VERDICTS[0]).when(low.contains("almost") | low.contains("not quite"), VERDICTS[1]).otherwise(VERDICTS[2])


def normalize_reviews(reviews: DataFrame, literal: bool = False) -> DataFrame:
    """``manuscript_id, round, score, verdict``; a score that is no number is 0."""
    score = F.coalesce(F.expr("try_cast(score_text as double)"), F.lit(0.0))
    return reviews.select("manuscript_id", "round", score.alias("score"), verdict(F.col("verdict_text"), literal).alias("verdict"))


def review_outcome(rounds: DataFrame, min_score: float = 6.0, acceptable: tuple[str, ...] = VERDICTS[:2]) -> DataFrame:
    """How the review of each manuscript ends: at its first good round, else with its last.

    ``manuscript_id, round, score, verdict, reason, n_rounds``; rounds after the good one don't count.
    """
    good = (F.col("score") >= min_score) & F.col("verdict").isin(*acceptable)
    marked = rounds.withColumn("_good", good)
    counts = marked.groupBy("manuscript_id").agg(F.min(F.when(F.col("_good"), F.col("round"))).alias("_well"), F.max("round").alias("_last"))
    end = F.coalesce("_well", "_last")
    found = marked.join(counts, "manuscript_id")
    n = found.where(F.col("round") <= end).groupBy("manuscript_id").agg(F.count("*").alias("n_rounds"))
    ends = first_per_key(found.where(F.col("round") == end), ["manuscript_id"], [F.col("_good").desc(), F.col("score").desc(), F.asc("verdict")])
    reason = F.when(F.col("_well").isNotNull(), "positive_assessment").otherwise("max_rounds")
    return ends.join(n, "manuscript_id").select("manuscript_id", "round", "score", "verdict", reason.alias("reason"), "n_rounds")
