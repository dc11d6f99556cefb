"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of ``folder``; the scan is lazy, so filters and column lists reach Parquet."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
