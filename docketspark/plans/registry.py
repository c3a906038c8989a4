"""The catalogue's registry: a query and, where SQL can express it, the DuckDB SQL it is held against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketspark.session import ship, usual_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def typed(sql: str, **types: str) -> str:
    """The SQL with columns cast to the types that the query gives them."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in types.items())}) FROM ({sql})"


def query(sql: str | None = None, name: str | None = None, **types: str):
    def register(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")

        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            usual_batches(spark)
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = typed(sql, **types) if types else sql
        return f

    return register
