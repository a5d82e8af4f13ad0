"""Runnable queries; importing this package registers all of them."""

from tidemark.registry import curation_queries, file_queries, memory_queries, observe_queries, plan_queries, session_queries, stream_queries, retrieval_queries, text_queries  # noqa: F401
from tidemark.registry.core import Tables, query, reference_sql, runners

__all__ = ["Tables", "query", "reference_sql", "runners"]
