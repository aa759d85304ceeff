"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from memspark.plans import answers, facts, graph_sessions, lifecycle, probes, rules, search, streams, whole  # noqa: F401
from memspark.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
