"""Work that must not grow faster than the input (findings of round 3)."""

from __future__ import annotations

from vellum.operators import identity as idn
from vellum.operators import layers as ly
from vellum.operators import titles as tt


def test_metrics_are_read_once(spark):
    """every metric used to be read for its cells and then once for each of three columns."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(f"p{i % 5}", f"m{i:03d}", "tax" if i % 2 else "discount", float(i), "about 3" if i % 3 == 0 else None, "u", {"line": str(i % 4)}) for i in range(60)]
    schema = "paper_id string, metric_id string, name string, value double, value_text string, unit string, condition map<string,string>"
    metrics = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    asked = [(1, "TAX"), (2, "about"), (3, "line"), (4, "zz"), (5, "tax"), (6, '"2"')]
    got = ly.matching_metrics(spark.createDataFrame(asked, "query_id long, text string"), metrics).collect()
    assert seen.value == len(rows)
    want = {}
    for q, text in asked:
        for p, m, name, _, value_text, _, condition in rows:
            cells = (name, value_text or "", '{"line":"%s"}' % condition["line"])
            if any(text.lower() in c.lower() for c in cells):
                want[q, p] = min(m, want.get((q, p), m))
    assert {(r.query_id, r.paper_id): r.metric_id for r in got} == want and len(got) == len(want)
    assert all(r.name == ("tax" if int(r.metric_id[1:]) % 2 else "discount") and r.condition == {"line": str(int(r.metric_id[1:]) % 4)} for r in got)


def test_titles_that_share_an_early_word_only(spark, monkeypatch):
    """each pair of these titles has one rare word and little else; all of them used to be told apart by their words."""
    kept = {}

    def spied(df, name, real=tt.written):
        kept[name] = real(df, name)
        return kept[name]

    monkeypatch.setattr(tt, "written", spied)
    words = [[f"own{i}x{j}" for j in range(9)] for i in range(40)]
    papers = [(f"p{i:02d}", " ".join(["x-1", *words[i]])) for i in range(40)]
    hints = [(i, " ".join(["x-1", *words[i][:7]])) for i in range(40)] + [(i + 40, " ".join(["x-1", *[w + "z" for w in words[i]]])) for i in range(40)]
    asked, had = spark.createDataFrame(hints, "hint_id long, hint string"), spark.createDataFrame(papers, "paper_id string, title string")
    got = tt.title_pairs(asked, had).collect()
    assert sorted((r.hint_id, r.paper_id, r.rule) for r in got) == [(i, f"p{i:02d}", "contained") for i in range(40)]
    assert kept["title-candidates"].count() == 40


def test_rounds_of_the_ladder_are_narrow(spark, monkeypatch):
    """titles and versions used to be moved and written in every round."""
    kept = []

    def spied(df, name, real=idn.written):
        kept.append((name, set(df.columns)))
        return real(df, name)

    monkeypatch.setattr(idn, "written", spied)
    kind = "candidate string, doi string, source_hash string, title string, processor_version string"
    rows = [(0, None, "d1", "h1", "One title", "1", False), (1, "p1", "d1", "h2", "one  TITLE", "1", False), (2, None, None, "h2", "Two", "1", False), (3, None, None, "h3", "One title", "2", False)]
    incoming = spark.createDataFrame(rows, f"seq long, {kind}, force boolean")
    papers = spark.createDataFrame([("p1", "d0", "h0", "Zero", "1")], kind.replace("candidate", "paper_id"))
    got = {r.seq: (r.decision, r.target, r.matched_by, r.warnings) for r in idn.resolve_identity(incoming, papers).collect()}
    assert got == {
        0: ("INSERTED", "#0", None, []),
        1: ("UPDATED", "p1", "paper_id", ["ID_DOI_CONFLICT", "SOURCE_CHANGED"]),
        2: ("BLOCKED", None, "source_hash", ["DUPLICATE_SOURCE"]),
        3: ("INSERTED", "#3", "title", ["POSSIBLE_DUPLICATE"]),
    }
    assert sum(name == "judged" for name, _ in kept) > 1
    assert not [name for name, columns in kept if name in ("judged", "holders") and columns & {"title", "processor_version"}]
