"""Constraint checks: each gives the rows, or the keys, that violate it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enum_violations(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows whose non-null value is outside the domain."""
    return df.filter(~F.col(column).isin(domain))


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, how many values are null: one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns])).alias("r")).select("r.*")


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def fk_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    return child.filter(F.col(child_key).isNotNull()).join(parent, F.col(child_key) == F.col(parent_key), "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows that stay when the ``deleted`` parents go."""
    return child.join(deleted, F.col(child_key) == F.col(parent_key), "left_anti")
