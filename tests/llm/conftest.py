"""Tables with every odd case: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

import pyarrow as pa
import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string, predicted string, size string, "
    "hash string, copies string, rep string, key string, band string, length string, rank string, posterior string, part string, held_out string"
)
N_EXTRA = 14
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while nine small birds sing in a tall green tree near the old stone bridge at dawn"


def odd_rows():
    rows = [
        (1, BASE, "en", "a", 10),
        (2, BASE, "en", "a", 10),
        (3, BASE + " today", "en", "b", 10),
        (4, None, "en", "b", None),
        (5, "", None, None, 0),
        (6, " \n\t ", "en", "a", 4),
        (7, "one", "en", "c", 3),
        (7, "one", "en", "c", 3),
        (8, "one two", None, "c", 7),
        (9, LONG, "en", "a", len(LONG)),
        (None, "a row without an id and with some words in it", "de", None, 1),
        (None, None, None, None, None),
        (10, "ünïcode  “quotes”  中文 text   and spaces", "fr", "b", 1),
        (11, "same id, first text of it", "en", "b", 1),
        (11, "same id, second text of it", "en", "b", 1),
    ]
    return [r + ("mine",) * N_EXTRA for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return pa.array([r[1] for r in odd_rows()], pa.string())
