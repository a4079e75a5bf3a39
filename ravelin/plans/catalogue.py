"""Registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from ravelin.plans import assembly_queries, contact_queries, graph_queries, model_queries, panel_queries, rule_queries, score_queries, source_queries, window_queries  # noqa: F401
from ravelin.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
