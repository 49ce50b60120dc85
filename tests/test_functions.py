"""Column functions against plain Python values."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import keys, render, scoring
from vellum.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("value", "shown"), [(10_000_000.0, "10000000.0"), (1.5, "1.5"), (0.0, "0.0"), (-123456789.0, "-123456789.0"), (12.25, "12.25")]
)
def test_numbers_are_plain(spark, value, shown):
    assert one(spark, render.number_text(F.col("v")), v=value) == shown


def test_search_terms_drop_single_letters(spark):
    assert one(spark, tx.search_terms(F.col("t")), t="A fast-Fourier x9 of é 12") == ["fast", "fourier", "x9", "of", "12"]


def test_token_estimate_is_one_at_least(spark):
    assert [one(spark, tx.estimate_tokens(F.col("t")), t=t) for t in ("", "abc", "a" * 41)] == [1, 1, 10]


def test_recency_is_clipped(spark):
    assert [one(spark, scoring.recency(F.col("y")), y=y) for y in (1990, 2015, 2040)] == [0.0, 0.5, 1.0]


def test_paper_id_pads(spark):
    got = one(spark, keys.paper_id(F.col("d"), F.col("y"), F.col("s")), d="EN", y=0, s=7)
    assert got == "EN_0000_007"
