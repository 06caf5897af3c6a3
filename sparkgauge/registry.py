"""Registries: queries with their SQL, and the plug-in surfaces of the engine."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows if there is one."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry(dict):
    """Named plug-ins of one surface. Only registered names can be used; nothing is imported by name."""

    def __init__(self, kind: str) -> None:
        super().__init__()
        self.kind = kind

    def register(self, name: str, value: Any = None) -> Any:
        if value is None:
            return lambda f: self.register(name, f)
        if name in self:
            raise ValueError(f"{self.kind} {name} is registered twice")
        self[name] = value
        return value

    def find(self, name: str) -> Any:
        if name not in self:
            raise KeyError(f"no {self.kind} named {name}; known: {', '.join(sorted(self))}")
        return self[name]


METRICS, AGGREGATIONS, FILTERS, RESPONDERS = (Registry(k) for k in ("metric", "aggregation", "filter", "responder"))
