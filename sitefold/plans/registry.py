"""Registered queries: name -> (survey row, Spark callable, optional SQL to check it against)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sitefold.runtime import ship_package


@dataclass(frozen=True)
class Query:
    name: str
    rows: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, rows: str, sql: str | None = None):
    """Register fn(spark, sf_dir). `rows` names the operator rows of the survey it covers."""
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = Query(name, rows, run, sql)
        return fn

    return add
