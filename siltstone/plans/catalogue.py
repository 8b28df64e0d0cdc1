"""All queries of the core and, where SQL can express them, the same query for DuckDB."""

from __future__ import annotations

from siltstone.plans import queries_models, queries_reports, queries_search, queries_text  # noqa: F401
from siltstone.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
