"""The queries of this package and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, licenses, mixing, neighbours, pieces, private, quality, sharding, tokencount, wrappers

MODULES = [wrappers, licenses, sharding, neighbours, private, pieces, jaccard, quality, tokencount, mixing]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in (module.ORACLE_SQL or {}).items()}
