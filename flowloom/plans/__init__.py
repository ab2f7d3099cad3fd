"""Registered queries, each with the SQL that must give the same rows."""

from flowloom.plans.registry import ORACLES, QUERIES
from flowloom.plans import relational, series, graphs, summaries  # noqa: F401  (they register)

__all__ = ["ORACLES", "QUERIES"]
