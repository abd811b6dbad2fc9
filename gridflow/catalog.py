"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridflow.plans import driver_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_queries.state_score(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(driver_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(driver_queries.SQL)
