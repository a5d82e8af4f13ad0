"""The list of runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[["Tables"], DataFrame]

_RUNNERS: dict[str, Runner] = {}
_SQL: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one directory."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query under `name`, with the SQL that must give the same rows."""

    def register(fn: Runner) -> Runner:
        if name in _RUNNERS:
            raise ValueError(f"query {name} registered twice")
        _RUNNERS[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def runners() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Runner) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, root: fn(Tables(spark, root))

    return {name: bind(fn) for name, fn in _RUNNERS.items()}


def reference_sql() -> dict[str, str]:
    return dict(_SQL)
