"""An index kept by batches against one that is built anew."""

import random

from vellum.operators import lexical as lx
from vellum.operators.segmented import SegmentedIndex

COLS = ("title", "body")
SCHEMA = "paper_id string, title string, body string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_random_batches_equal_a_rebuild(spark, tmp_path):
    dice, live = random.Random(6), {}
    index = SegmentedIndex(spark, f"file://{tmp_path}/index", COLS)
    words = "mask lens resist learning deep light source Étude".split()
    text = lambda: " ".join(dice.choices(words, k=dice.randrange(6))) if dice.random() < 0.9 else None
    queries = lx.query_terms(spark.createDataFrame([(1, "mask lens"), (2, "deep deep etude"), (3, "nothing")], "query_id long, text string"))
    for batch in range(5):
        new = {f"p{dice.randrange(15)}": (text(), text()) for _ in range(dice.choice([0, 4, 8]))}
        gone = {f"p{dice.randrange(15)}" for _ in range(2)} - set(new)
        docs = spark.createDataFrame([(k, *x) for k, x in new.items()], SCHEMA)
        deleted = spark.createDataFrame([(k,) for k in gone], "paper_id string")
        index.update(f"b{batch}", docs, deleted)
        index.update(f"b{batch}", docs.limit(0))  # a replay
        live = {k: x for k, x in live.items() if k not in gone} | new
        if batch == 2:
            index.merge()
        if batch % 2 == 0:
            whole = lx.build_index(spark.createDataFrame([(k, *x) for k, x in live.items()], SCHEMA), ["paper_id"], COLS)
            kept = index.index()
            assert rows_of(kept.postings.select("paper_id", "term", "tf", "dl")) == rows_of(whole.postings.select("paper_id", "term", "tf", "dl"))
            assert [tuple(r) for r in kept.stats.collect()] == [tuple(r) for r in whole.stats.collect()]
            assert rows_of(kept.freq) == rows_of(whole.postings.groupBy("term").count())
            for match in (lx.match_any, lx.match_all):
                assert rows_of(match(kept, queries)) == rows_of(match(whole, queries))


def test_deleting_everything(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/index", COLS)
    docs = spark.createDataFrame([("a", "one", None), ("b", None, None)], SCHEMA)
    one = index.update("one", docs)
    index.update("two", docs.limit(0), docs.select("paper_id"))
    kept = index.index()
    assert kept.postings.count() == 0 and kept.freq.count() == 0 and kept.stats.first().n_docs == 0
    assert index.index(one).postings.count() == 1
    terms = lx.query_terms(spark.createDataFrame([(1, "one")], "query_id long, text string"))
    assert lx.match_any(kept, terms).count() == 0
