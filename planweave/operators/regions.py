"""Connected regions of free space on a grid of walls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweave.operators.plane import REGION_TYPES, REGIONS, plan_by_plan, small_regions
from planweave.operators.rooms import LARGEST_SHARE, LEAST_AREA
from planweave.sources.scratch import Round

#: Width of the cells in which runs of neighbouring rows meet.
CELL = 64


def free_runs(walls: DataFrame, frames: DataFrame) -> DataFrame:
    """(plan, y, x1, x2): the maximal runs of free pixels in each row of each plan (frames: plan, width, height) between its wall pixels (plan, x, y).

    A row's wall pixels and its two edges stand in one window; between two that follow each other lies a run.
    """
    rows = frames.select("plan", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    edges = rows.select("plan", "y", F.explode(F.array(F.lit(-1), F.col("width"))).alias("x"))
    inside = F.expr("x >= 0 AND x < width AND y >= 0 AND y < height")
    stops = walls.join(frames, "plan").filter(inside).select("plan", "y", "x").distinct().unionByName(edges.select("plan", "y", "x"))
    last = F.lag("x").over(Window.partitionBy("plan", "y").orderBy("x"))
    return stops.select("plan", "y", (last + 1).alias("x1"), (F.col("x") - 1).alias("x2")).filter("x1 <= x2")


def touching(runs: DataFrame, corners: bool = True) -> DataFrame:
    """(a, b): runs (plan, y, x1, x2, run) of neighbouring rows that share a side, or a corner too."""
    reach = 1 if corners else 0
    at = lambda c: F.floor(c / CELL).cast("long")
    low, high = F.col("x1") - reach, F.col("x2") + reach
    upper = runs.select("plan", (F.col("y") + 1).alias("y"), F.col("run").alias("a"), low.alias("low"), high.alias("high"), at(low).alias("__first"), F.explode(F.sequence(at(low), at(high))).alias("cell"))
    lower = runs.select("plan", "y", F.col("run").alias("b"), "x1", "x2", at(F.col("x1")).alias("__from"), F.explode(F.sequence(at(F.col("x1")), at(F.col("x2")))).alias("cell"))
    # a pair counts in the first cell that both reach
    met = upper.join(lower, ["plan", "y", "cell"]).filter(F.col("cell") == F.greatest("__first", "__from"))
    return met.filter("low <= x2 AND x1 <= high").select("a", "b")


def labelled_runs(runs: DataFrame, corners: bool = True) -> DataFrame:
    """``runs`` (plan, y, x1, x2) with ``region``, the number of the first run that each hangs together with.

    Every run takes the least label of itself and those it touches, and then that label's own, until no label changes; joins by run, so no region
    stands in one task.
    """
    numbered = Round(runs.select("plan", "y", "x1", "x2", F.monotonically_increasing_id().alias("run"))).table
    pairs = touching(numbered, corners)
    both = Round(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))).table
    now = Round(numbered.select("run", F.col("run").alias("label")))
    while True:
        labels = now.table
        near = both.join(labels.select(F.col("run").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["run"] == near["a"], "left").select("run", "label", F.least("label", "near").alias("least"))
        jump = labels.select(F.col("run").alias("least"), F.col("label").alias("further"))
        after = Round(least.join(jump, "least").select("run", F.least("least", "further").alias("label"), (F.least("least", "further") < F.col("label")).alias("moved")))
        now.drop()
        now = after
        if now.table.filter("moved").isEmpty():
            return numbered.join(now.table.select("run", F.col("label").alias("region")), "run").drop("run")


def regions(runs: DataFrame, corners: bool = True, small: int | None = None) -> DataFrame:
    """(plan, area, first): the regions of runs (plan, y, x1, x2) with their first pixel (y, x). Plans of at most ``small`` runs are labelled many at a time in one pass
    over all runs; only larger ones go through the joins."""
    reach = 1 if corners else 0
    made, large = plan_by_plan(runs.select("plan", "y", "x1", "x2"), lambda number, part: small_regions(number, part, reach), REGIONS, REGION_TYPES, small)
    found = made.select("plan", "area", F.struct("y", "x").alias("first"))
    if large.isEmpty():
        return found
    long = [F.col(c).cast("long").alias(c) for c in ("y", "x1", "x2")]
    first = F.min(F.struct("y", F.col("x1").alias("x"))).alias("first")
    return found.unionByName(labelled_runs(large.select("plan", *long), corners).groupBy("plan", "region").agg(F.sum(F.col("x2") - F.col("x1") + 1).alias("area"), first).drop("region"))


def free_rooms(walls: DataFrame, frames: DataFrame, least_area: float = LEAST_AREA, largest_share: float = LARGEST_SHARE, corners: bool = True, small: int | None = None) -> DataFrame:
    """(plan, room, area, x, y): regions of free pixels within the area limits, numbered by area, largest first, ties by their first pixel in the order of rows (x, y).

    ``walls`` has the wall pixels (plan, x, y; repeats and those outside the frame count for nothing), ``frames`` plan, width and height.
    """
    found = regions(free_runs(walls, frames), corners, small).join(frames, "plan")
    kept = found.filter((F.col("area") >= least_area) & (F.col("area") <= largest_share * F.col("width") * F.col("height")))
    number = F.row_number().over(Window.partitionBy("plan").orderBy(F.desc("area"), "first"))
    return kept.select("plan", F.concat(F.lit("room-"), number.cast("string")).alias("room"), "area", "first.x", "first.y")
