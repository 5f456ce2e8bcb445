"""Collecting named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.found: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name, with the SQL that gives the same rows if there is any."""

        def keep(f: Query) -> Query:
            self.found[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep

    def queries(self) -> dict[str, Query]:
        return dict(self.found)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)
