"""Registered queries over the driver tables and their oracle SQL."""

from vellum.suite import identity, ingest, manuscripts, ranking, search, segmenting  # noqa: F401
from vellum.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
