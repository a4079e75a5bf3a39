"""Queries and their SQL twins, registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of tables; `t(name)` reads one."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str, name: str | None = None) -> Column:
    """Six decimals, for figures that two engines sum in different orders."""
    column = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return column.alias(name or (c if isinstance(c, str) else "value"))
