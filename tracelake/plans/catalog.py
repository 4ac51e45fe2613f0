"""All registered queries of the analytic operators and their SQL."""

from __future__ import annotations

from tracelake.plans import details, exchanges, measures, programs, relations, texts  # noqa: F401  (they register themselves)
from tracelake.plans.registry import ORACLE_SQL, QUERIES, Query

FLAGSHIP = "gate_summary"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "Query"]
