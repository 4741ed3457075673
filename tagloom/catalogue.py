"""All registered queries of the core and their oracle SQL."""

from __future__ import annotations

from tagloom.plans import evidence_queries, flow_queries, function_queries, graph_queries, hierarchy_queries, more_queries, resolve_queries, search_queries, stats_queries, store_queries, surface_queries

_MODULES = [search_queries, stats_queries, graph_queries, function_queries, store_queries, resolve_queries, evidence_queries, flow_queries, more_queries, hierarchy_queries, surface_queries]

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
