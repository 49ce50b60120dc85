from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from vellum.llm import weak_quality
from vellum.llm.common import table


@pytest.fixture(scope="module")
def steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(table(stage(spark, out[-1], small), "step"))
    return out


def test_each_stage_works_on_what_the_one_before_kept(steps, spark, small):
    from tests_brute import kept_of_groups

    ids = [Counter(r.doc_id for r in s.select("doc_id").collect()) for s in steps]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:], strict=False))
    assert all(s.columns == steps[0].columns for s in steps[1:5])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = {i for i, r in labels.items() if r.quality == 1}
    assert good <= set(ids[1])
    clean = {i for i in set(ids[1]) & set(labels) if labels[i].toxic == 0}
    assert len(clean - set(ids[2])) <= 0.02 * len(clean)
    assert set(ids[3]) == kept_of_groups(steps[2].collect())
    assert max(ids[4].values()) <= 3
    pieces = defaultdict(int)
    for r in steps[5].collect():
        pieces[r.doc_id] += r.piece == 0
    assert dict(pieces) == dict(ids[4])


def test_run_equals_the_steps(steps, spark, small):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (Counter(map(tuple, x.select(*key).collect())) for x in (corpus_pipeline.run(spark, small), steps[5]))
    assert a == b


def test_stages_on_odd_rows(spark, odd, none, small):
    for some in (odd, none):
        docs = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = table(stage(spark, docs, small), "odd")
            assert docs.columns == odd.columns and docs.where("score <> 'mine'").count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= docs.count()
    assert weak_quality.classified(none).count() == 0
