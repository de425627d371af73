"""Registers a query of tables together with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ohmgrid.tables import table


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        """Decorates a function of t, which gives a table by its name."""

        def add(f):
            self.queries[name] = lambda spark, d: f(lambda n: table(spark, d, n))
            if sql:
                self.sql[name] = sql
            return f

        return add
