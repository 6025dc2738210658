"""Registered queries over the given tables, grouped as in the operator inventory."""

from verdigris.plans import linkage, models, ordering, projections, sources, statistics, textual  # noqa: F401
from verdigris.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
