"""All queries of the core with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postloom.plans import evaluate_queries, profile_queries, rewrite_queries

_MODULES = (profile_queries, evaluate_queries, rewrite_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.SQL.items()}
