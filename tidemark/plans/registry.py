"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import with_views

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        """Register a query; sql is its equivalent over the base tables and the named views."""

        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name!r} is registered twice")
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = with_views(sql, *views) if views else sql
            return query

        return register
