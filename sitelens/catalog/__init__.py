"""Query catalogue: each module pairs Spark builders with the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitelens.catalog import corpus, evidence, ingest, portfolio, records, search, spatial, wider

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (search, spatial, corpus, portfolio, evidence, ingest, records, wider)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= module.SQL
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(spark, sf_dir)
