"""All queries of the engine, by name, with the DuckDB SQL that states each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["bm25_topk"](spark, sf_dir)


from tessera.plans import builds, decoding, history, indexes, lifecycle, migration, more, negatives, registry, requests, retrieval, serving, streams  # noqa: E402, F401  (the plans register themselves)
