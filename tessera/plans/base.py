"""A book of queries, each with the SQL that it is compared with (None where SQL can't express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(name)
        self.queries[name] = query
        if sql:
            self.sql[name] = sql
