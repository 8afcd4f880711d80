"""Queries of the engine's own operators and their SQL."""

from __future__ import annotations

from wrenmill.plans import case_graph_queries, decision_queries, event_queries, hierarchy_queries, kernel_queries, pair_queries, text_queries, topic_queries

FLAGSHIP = "d4_pair_decisions"
QUERIES: dict = {}
SQL: dict = {}
for module in (text_queries, decision_queries, event_queries, hierarchy_queries, kernel_queries, case_graph_queries, topic_queries, pair_queries):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
