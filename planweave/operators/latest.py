"""Latest-per-key, sequence numbers and cursor replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``; the last of ``order`` breaks ties.

    ``max_by`` aggregates on the map side, so a hot key ships one row a task and no sort is needed.
    """
    payload = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(F.max_by(payload, F.struct(*order)).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def next_sequence(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The sequence number that the next row of each key gets."""
    return df.groupBy(*keys).agg((F.coalesce(F.max(sequence), F.lit(0)) + 1).alias("next_sequence"))


def assign_sequence(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "sequence_no") -> DataFrame:
    """Dense numbers from 1 within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def replay_since(df: DataFrame, sequence: str, cursor: int | str | None) -> DataFrame:
    """Rows after the cursor; a cursor that is no integer replays everything."""
    try:
        after = int(cursor)
    except (TypeError, ValueError):
        return df
    return df.filter(F.col(sequence) > after)
