"""Registry of the named queries: Spark plan, oracle SQL and survey rows covered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wardline.plans.telemetry import Tables, duckdb_text
from wardline.session import MEASURED_BROADCASTS, SETTINGS, configure


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(configure(spark, SETTINGS | MEASURED_BROADCASTS), sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle text."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, tuple(covers.split()), fn, duckdb_text(sql) if sql else None)
        return fn

    return register
