"""Access to the provided tables, and the registry each binding module fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[..., Callable[[Query], Query]]]:
    """(queries, oracle SQL, decorator that enters a function under the given name)."""
    queries: dict[str, Query] = {}
    oracle: dict[str, str] = {}

    def enter(name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            queries[name] = f
            if sql is not None:
                oracle[name] = sql
            return f

        return keep

    return queries, oracle, enter
