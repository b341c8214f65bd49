"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from voltmill.sources.driver_tables import Star, with_star

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **ctes: str) -> Callable:
    """Register a function of a Star as a query; sql is DuckDB SQL over the star's definitions and ctes."""

    def add(build: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: build(Star(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_star(sql, **ctes)
        return build

    return add
