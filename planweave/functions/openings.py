"""Doors and windows: classes, rectangles and solids; deskew angles; fidelity scores; canvas scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planweave.functions.geometry import extruded
from planweave.sources.blobs import DEFAULTS

#: Pixels from the left or upper edge within which an opening is taken for a window.
EDGE = 5


def on_edge(points: Column) -> Column:
    """Whether one of the first two points lies on the left or upper edge."""
    return F.coalesce(F.exists(F.slice(points, 1, 2), lambda p: (p["x"] <= EDGE) | (p["y"] <= EDGE)), F.lit(False))


def gap_rectangle(a: Column, b: Column, thickness: Column) -> Column:
    """Corners of a gap between two points on a wall: half the wall's thickness, 5 pixels at least, to either side."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    half = F.greatest((thickness / 2).cast("int"), F.lit(5))
    corner = lambda p, side: F.struct((p["x"] - side * half * dy / length).alias("x"), (p["y"] + side * half * dx / length).alias("y"))
    return F.when(length.isNotNull(), F.array(corner(a, 1), corner(b, 1), corner(b, -1), corner(a, -1)))


def opening_solid(a: Column, b: Column, window: Column, wall_thickness: Column) -> Column:
    """The solid of an opening between two points in metres; a width below 5 cm counts as 40 % of a door's height, half a
    metre at least. Windows begin at their sill, doors on the floor."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = F.sqrt(dx * dx + dy * dy)
    width = F.when(length < 0.05, F.greatest(F.lit(0.5), F.lit(0.4 * DEFAULTS["door_default_height"]))).otherwise(length)
    along = F.atan2(dy, dx)
    wx, wy = F.cos(along) * width / 2, F.sin(along) * width / 2
    nx, ny = -F.sin(along) * wall_thickness * 0.6, F.cos(along) * wall_thickness * 0.6
    cx, cy = (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2
    corner = lambda w, n: F.struct((cx + w * wx + n * nx).alias("x"), (cy + w * wy + n * ny).alias("y"))
    low = F.when(window, F.lit(DEFAULTS["window_sill_height"])).otherwise(0.0)
    height = F.when(window, F.lit(DEFAULTS["window_default_height"])).otherwise(F.lit(DEFAULTS["door_default_height"]))
    return extruded(F.array(corner(-1, 1), corner(1, 1), corner(1, -1), corner(-1, -1)), low, low + height)


def deskew(degrees: Column) -> Column:
    """An angle in [0, 180) folded about the nearest axis."""
    return F.when(degrees > 135, degrees - 180).when(degrees > 45, degrees - 90).otherwise(degrees)


def skew(median: Column) -> Column:
    """The skew of a drawing from the median of its folded angles; below 0.3 degrees there is none."""
    return F.when(F.abs(median) < 0.3, 0.0).otherwise(median)


def rotation(skewed: Column) -> Column:
    """The turn that straightens a drawing, against its skew; below half a degree there is none."""
    return F.when(F.abs(skewed) > 0.5, -skewed).otherwise(0.0)


def area_accuracy(mean_relative_error: Column) -> Column:
    return 1.0 - F.least(F.coalesce(mean_relative_error, F.lit(0.0)), F.lit(1.0))


def fidelity(rooms: Column, walls: Column | None = None) -> Column:
    """Weighted score of wall positions, room areas, consistency and topology; the last two are met by construction."""
    return F.round(0.4 * (F.lit(1.0) if walls is None else walls) + 0.3 * rooms + 0.2 + 0.1, 4)


def canvas_scale(width: Column, height: Column, side: int = 700) -> Column:
    """What fits a drawing into a square canvas without growing it; missing sizes count as 800 by 600."""
    known = lambda v, default: F.coalesce(F.nullif(v, F.lit(0)), F.lit(default))
    return F.least(side / known(width, 800), side / known(height, 600), F.lit(1.0))
