"""Names every query of the library and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planweave.plans import drawing, eventlog, relational, spatial

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (relational, eventlog, spatial, drawing)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
