"""The queries on the driver's tables and the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import extra_queries, mining_queries, quality_queries, report_queries

_PARTS = (mining_queries, quality_queries, extra_queries, report_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL: dict[str, str] = {k: s for part in _PARTS for k, s in part.SQL.items()}
