"""Gaps and islands: line grouping and runs below a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.text import stripped


def line_numbers(df: DataFrame, keys: list[str], order: list[str], position: Column, limit: float, name: str = "line_no") -> DataFrame:
    """Numbers lines from 1: a row begins one when its position is more than ``limit`` from the row before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    jump = F.abs(position - F.lag(position).over(w)) > limit
    return df.withColumn(name, F.sum(F.coalesce(jump.cast("int"), F.lit(0))).over(w) + 1)


def runs_below(df: DataFrame, keys: list[str], order: list[str], value: str, threshold: float, at: str) -> DataFrame:
    """Runs of rows below the threshold: first ``at``, the ``at`` of the row that closes the run (the run's own
    last row where none follows), and the rows in it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    low = F.col(value) < threshold
    marked = df.withColumn("__low", low).withColumn("__run", F.sum((~low).cast("int")).over(w)).withColumn("__next", F.coalesce(F.lead(at).over(w), F.col(at)))
    grouped = marked.filter("__low").groupBy(*keys, "__run").agg(F.min(at).alias("opens_at"), F.max("__next").alias("closes_at"), F.count("*").alias("n"))
    return grouped.drop("__run")


def word_lines(words: DataFrame, keys: list[str], order: list[str], line_height: float = 20) -> DataFrame:
    """keys, line_no, text, x, y, width, height: words (text, x, y, w, h) in lines, a line beginning where a word lies
    more than ``line_height`` above or below the one before; its box holds all its words, its text joins them by
    spaces. Words of white space only are left out."""
    kept = words.filter(stripped(F.col("text")) != "")
    lines = line_numbers(kept, keys, order, F.col("y"), line_height)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, stripped(F.col("text")).alias("__text")))), lambda t: t["__text"]), " ")
    boxes = lines.groupBy(*keys, "line_no").agg(texts.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    return boxes.select(*keys, "line_no", "text", "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"))


def section_means(samples: DataFrame, keys: list[str], ink: str, across: Column) -> DataFrame:
    """keys and ``mean``: the ink across a section of ``across`` samples; samples outside of the drawing are missing
    or null and count as blank."""
    return samples.groupBy(*keys).agg((F.sum(F.coalesce(F.col(ink), F.lit(0))) / F.greatest(F.max(across), F.lit(1))).alias("mean"))


def wall_gaps(profile: DataFrame, wall: str, t: str, value: str, length: str, threshold: float = 60.0, least: float = 25.0, most: float = 200.0) -> DataFrame:
    """wall, opens_at, closes_at, position, width_px: gaps in a wall's profile (t from 0 to 1) where the ink is below the
    threshold. A gap closes at the first sample that is not, the last one at the wall's end; only widths strictly
    between the bounds count."""
    w = Window.partitionBy(wall).orderBy(t)
    low = F.col(value) < threshold
    marked = profile.withColumn("__low", low).withColumn("__run", F.sum((~low).cast("int")).over(w)).withColumn("__next", F.coalesce(F.lead(t).over(w), F.lit(1.0)))
    runs = marked.filter("__low").groupBy(wall, "__run").agg(F.min(t).alias("opens_at"), F.max("__next").alias("closes_at"), F.max(length).alias("__length"))
    width = (F.col("closes_at") - F.col("opens_at")) * F.col("__length")
    gaps = runs.select(wall, "opens_at", "closes_at", ((F.col("opens_at") + F.col("closes_at")) / 2).alias("position"), width.alias("width_px"))
    return gaps.filter((F.col("width_px") > least) & (F.col("width_px") < most))


def boundary_open(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``is_open``: whether an edge (samples, hits) of the boundary has wall under less than 30 % of its samples."""
    return edges.groupBy(*keys).agg(F.bool_or(F.col("hits") < F.col("samples") * 0.3).alias("is_open"))
