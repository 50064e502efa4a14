"""All queries of the reference's operators, with the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import analysis_queries, code_queries, decision_queries, event_queries, finding_queries, graph_queries, policy_queries, sink_queries, source_queries, text_queries  # noqa: F401  they register themselves
from tessera.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "q_flagship_suppliers"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
