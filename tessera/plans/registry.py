"""All queries over the quant domain, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import feature_queries, ingest_queries, league_queries, metric_queries, portfolio_queries, regime_queries, risk_queries, signal_queries

BOOKS = [
    m.book
    for m in (ingest_queries, feature_queries, signal_queries, league_queries, regime_queries, portfolio_queries, risk_queries, metric_queries)
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for b in BOOKS for name, q in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for b in BOOKS for name, q in b.sql.items()}
