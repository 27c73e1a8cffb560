"""All registered queries of the library's own operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import catalog_queries, feature_queries, fitted_queries, guard_queries, measure_queries, model_queries, store_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (measure_queries, feature_queries, catalog_queries, guard_queries, model_queries, fitted_queries, store_queries)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_queries.panel_rank_ic(spark, sf_dir)
