"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import arms, estate, graph, history, lookups, records, workflow  # noqa: F401  each registers its queries
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "impact_score"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
