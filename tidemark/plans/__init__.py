"""Registered queries."""

from tidemark.plans import answer_queries, graph_queries, ingest_queries, monitor_queries, relational_queries, search_queries, store_queries  # noqa: F401
