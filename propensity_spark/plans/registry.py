"""The registered queries: name -> (DataFrame query, the same query as SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from propensity_spark.plans.bindings import sql_with
from propensity_spark.sources.readers import Tables

QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None, uses: list[str] | None = None):
    """Register a function of Tables under its own name. `uses` names the bound frames the SQL reads."""

    def add(fn: Callable[[Tables], DataFrame]):
        text = sql if sql is None or not uses else sql_with(uses, sql)
        QUERIES[fn.__name__] = (fn, text)
        return fn

    return add


def runner(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))
