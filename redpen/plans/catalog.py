"""All registered queries: importing this fills the registry."""

from __future__ import annotations

from redpen.plans import edit_queries, join_queries, replay_queries, score_queries, state_queries  # noqa: F401
from redpen.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
