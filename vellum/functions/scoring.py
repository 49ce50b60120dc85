"""Relevance terms and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum import vocab


def recency(year: Column, base: int = 2000, span: int = 30) -> Column:
    scaled = (year - base) / F.lit(span)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)), F.lit(0.0))


def tag_match(tags: Column, term: Column) -> Column:
    """Any tag contains the term, ignoring case."""
    low = F.lower(term)
    return F.coalesce(F.exists(tags, lambda t: F.instr(F.lower(t), low) > 0), F.lit(False))


def domain_match(paper_id: Column, domain_tags: Column, domain: Column) -> Column:
    prefix = F.concat(F.upper(domain), F.lit("_"))
    return F.startswith(F.upper(paper_id), prefix) | tag_match(domain_tags, domain)


def filter_checks(f: dict[str, Column], p: dict[str, Column]) -> dict[str, Column]:
    """One boolean per filter; null where the filter is not supplied."""
    tests = {
        "year_from": F.coalesce(p["year"] >= f["year_from"], F.lit(False)),
        "year_to": F.coalesce(p["year"] <= f["year_to"], F.lit(False)),
        "domain": domain_match(p["paper_id"], p["domain_tags"], f["domain"]),
        "method": tag_match(p["method_tags"], f["method"]),
        "venue": F.coalesce(F.instr(F.lower(p["venue"]), F.lower(f["venue"])) > 0, F.lit(False)),
    }
    return {name: F.when(f[name].isNotNull(), test) for name, test in tests.items()}


def passes(checks: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in checks.values():
        out = out & F.coalesce(c, F.lit(True))
    return out


def metadata_match(checks: dict[str, Column]) -> Column:
    """Satisfied filters over supplied filters; 0 when none is supplied."""
    met = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in checks.values()), F.lit(0))
    asked = sum((c.isNotNull().cast("int") for c in checks.values()), F.lit(0))
    return F.when(asked > 0, met / asked).otherwise(F.lit(0.0))


def centrality(degree: Column, max_degree: Column) -> Column:
    return F.when(max_degree > 0, F.coalesce(degree, F.lit(0)) / max_degree).otherwise(F.lit(0.0))


def _weighted(weights, parts) -> Column:
    total = sum((F.lit(w) * part for w, part in zip(weights, parts)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def score_lexical(bm25: Column, rec: Column, meta: Column, cent: Column) -> Column:
    return _weighted(vocab.LEXICAL_WEIGHTS, (bm25, rec, meta, cent))


def score_hybrid(bm25: Column, vector: Column, rec: Column, meta: Column, cent: Column) -> Column:
    """Five-term weights where the row has a vector term, four-term weights elsewhere."""
    five = _weighted(vocab.HYBRID_WEIGHTS, (bm25, vector, rec, meta, cent))
    return F.when(vector.isNotNull(), five).otherwise(score_lexical(bm25, rec, meta, cent))
