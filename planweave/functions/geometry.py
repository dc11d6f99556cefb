"""Angles, intervals, rings, coordinates and solids as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from planweave.functions.text import short_id


def angle(dx: Column, dy: Column) -> Column:
    """Degrees in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def orientation(degrees: Column) -> Column:
    return F.when((degrees < 3) | (degrees > 177), "horizontal").when(F.abs(degrees - 90) < 3, "vertical")


def overlap_ratio(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Shared part of two intervals against the longer one, which counts as one unit at least."""
    shared = F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))
    return shared / F.greatest(a2 - a1, b2 - b1, F.lit(1))


def ring_area(ring: Column) -> Column:
    """Shoelace area of array<struct<x, y>>; fewer than three points give 0."""
    n = F.size(ring)
    after = lambda i: ring[(i + 1) % F.greatest(n, F.lit(1))]
    cross = F.transform(ring, lambda p, i: p["x"] * after(i)["y"] - after(i)["x"] * p["y"])
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda a, c: a + c)) / 2)


def centroid(ring: Column) -> Column:
    """The mean of the vertices."""
    total = lambda k: F.aggregate(F.transform(ring, lambda p: p[k].cast("double")), F.lit(0.0), lambda a, v: a + v)
    n = F.nullif(F.size(ring), F.lit(0))
    return F.struct((total("x") / n).alias("x"), (total("y") / n).alias("y"))


def to_meters(x: Column, y: Column, min_x: Column, max_y: Column, px_per_meter: Column) -> Column:
    """Pixel to metre, y turned round."""
    return F.struct(F.try_divide(x - min_x, px_per_meter).alias("x"), F.try_divide(max_y - y, px_per_meter).alias("y"))


def snap(v: Column, grid: int = 5) -> Column:
    return F.bround(v / grid) * grid


def wall_thickness(thickness_px: Column, px_per_meter: Column, default: float = 0.15) -> Column:
    meters = F.try_divide(thickness_px, px_per_meter)  # greatest() and least() skip nulls
    return F.when(meters.isNotNull(), F.least(F.greatest(meters, F.lit(0.05)), F.lit(0.8))).otherwise(F.lit(default))


def wall_quad(a: Column, b: Column, thickness: Column) -> Column:
    """Four corners of a wall of that thickness around the segment a-b; null for a segment below a millimetre."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = F.sqrt(dx * dx + dy * dy)
    nx, ny = -dy / length * thickness / 2, dx / length * thickness / 2
    corner = lambda p, s: F.struct((p["x"] + s * nx).alias("x"), (p["y"] + s * ny).alias("y"))
    return F.when(length >= 0.001, F.array(corner(a, 1), corner(b, 1), corner(b, -1), corner(a, -1)))


def offset_ring(ring: Column, distance: float, quarter: int = 16) -> Column:
    """A ring (against the clock, y up) moved outwards: corners that turn left become arcs of ``quarter`` steps a quarter turn,
    corners that turn right stay corners, straight ones go. Edges at a corner that turns right are longer than the distance."""
    n = F.size(ring)

    def unit(a: Column, b: Column) -> Column:
        dx, dy = (b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double")
        return F.transform(F.array(F.sqrt(dx * dx + dy * dy)), lambda l: F.struct((dx / l).alias("x"), (dy / l).alias("y")))[0]

    def moved(p: Column, x: Column, y: Column) -> Column:
        return F.struct((p["x"] + distance * x).alias("x"), (p["y"] + distance * y).alias("y"))

    def turned(v: Column) -> Column:
        d, e = v["d"], v["e"]  # the way to the corner and the way from it
        cross, dot = d["x"] * e["y"] - d["y"] * e["x"], d["x"] * e["x"] + d["y"] * e["y"]
        return F.struct(v["p"].alias("p"), d.alias("d"), e.alias("e"), cross.alias("cross"), dot.alias("dot"), F.atan2(-d["x"], d["y"]).alias("start"), F.atan2(cross, dot).alias("turn"))

    def arc(v: Column) -> Column:
        steps = F.greatest(F.lit(1), F.ceil(v["turn"] / (F.pi() / (2 * quarter)) - 1e-9)).cast("int")
        at = lambda k, n: v["start"] + v["turn"] * k / n
        return bound(steps, lambda n: F.transform(F.sequence(F.lit(0), n), lambda k: bound(at(k, n), lambda a: moved(v["p"], F.cos(a), F.sin(a)))))

    def corner(v: Column) -> Column:
        p, d, e = v["p"], v["d"], v["e"]
        inner = F.array(moved(p, (d["y"] + e["y"]) / (1 + v["dot"]), -(d["x"] + e["x"]) / (1 + v["dot"])))
        return F.when(v["cross"] > 1e-12, arc(v)).when(v["cross"] < -1e-12, inner).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

    ways = F.transform(ring, lambda p, i: F.struct(p.alias("p"), unit(ring[(i + n - 1) % n], p).alias("d"), unit(p, ring[(i + 1) % n]).alias("e")))
    return F.flatten(F.transform(F.transform(ways, turned), corner))


def roof_solid(outline: Column, low: Column, height: Column) -> Column:
    """A slab of that height on top of the ceilings, drawn over the moved outline."""
    return extruded(outline, low, low + height)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it stands there."""
    return F.transform(F.array(value), body)[0]


def extruded(ring: Column, low: Column, high: Column) -> Column:
    """struct<vertices, faces> of a ring drawn up from ``low`` to ``high``: two triangles a side, caps as fans."""

    def solid(r: Column, n: Column) -> Column:
        level = lambda z: F.transform(r, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"), z.cast("double")))

        def side(i: Column) -> Column:
            j = (i + 1) % n
            return F.array(F.array(i, j, i + n), F.array(j, j + n, i + n))

        def cap(i: Column) -> Column:
            return F.array(F.array(F.lit(0), i + 1, i), F.array(n, i + n, i + n + 1))

        faces = F.concat(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), side)), F.flatten(F.transform(F.sequence(F.lit(1), n - 2), cap)))
        return F.when(n >= 3, F.struct(F.concat(level(low), level(high)).alias("vertices"), faces.alias("faces")))

    # the ring may be a long expression
    return bound(ring, lambda r: bound(F.size(r), lambda n: solid(r, n)))


def wall_solid(a: Column, b: Column, thickness: Column, height: Column) -> Column:
    """A wall on its centre line, from the floor up to ``height``."""
    return extruded(wall_quad(a, b, thickness), F.lit(0.0), height)


def floor_solid(ring: Column, slab: Column) -> Column:
    """A slab below a room's floor."""
    return extruded(ring, -slab, F.lit(0.0))


def ceiling_solid(ring: Column, height: Column, slab: Column) -> Column:
    """A slab above a room."""
    return extruded(ring, height, height + slab)


def wall_record(a: Column, b: Column, thickness: Column, horizontal: Column, *name: Column) -> Column:
    """The wall between two parallel lines struct<x1, y1, x2, y2>: centre line, box, thickness, type and length in pixels.

    Along the wall it reaches as far as either line, across from the middle of one to the middle of the other.
    Coordinates are cut to whole pixels. The id depends on ``name`` alone.
    """
    xs, ys = [p[c] for p in (a, b) for c in ("x1", "x2")], [p[c] for p in (a, b) for c in ("y1", "y2")]
    middle = lambda p, c: (p[f"{c}1"] + p[f"{c}2"]) / 2
    xa, xb, ya, yb = middle(a, "x"), middle(b, "x"), middle(a, "y"), middle(b, "y")
    cut = lambda v: v.cast("int")
    low_x, high_x = (cut(F.when(horizontal, f(*xs)).otherwise(f(xa, xb))) for f in (F.least, F.greatest))
    low_y, high_y = (cut(F.when(horizontal, f(ya, yb)).otherwise(f(*ys))) for f in (F.least, F.greatest))
    mid_x, mid_y = cut((xa + xb) / 2), cut((ya + yb) / 2)
    start = F.when(horizontal, F.array(low_x, mid_y)).otherwise(F.array(mid_x, low_y))
    end = F.when(horizontal, F.array(high_x, mid_y)).otherwise(F.array(mid_x, high_y))
    length = F.sqrt(F.pow(end[0] - start[0], 2) + F.pow(end[1] - start[1], 2))
    return F.struct(
        short_id("wall", *name).alias("id"),
        F.array(start, end).alias("geometry"),
        F.array(F.array(low_x, low_y), F.array(high_x, low_y), F.array(high_x, high_y), F.array(low_x, high_y)).alias("polygon_px"),
        F.round(thickness.cast("double"), 1).alias("thickness_px"),
        F.when(thickness >= 15, "exterior").otherwise("interior").alias("wall_type"),
        F.when(horizontal, "horizontal").otherwise("vertical").alias("orientation"),
        F.round(length, 1).alias("length_px"),
        F.lit(0.85).alias("confidence"),
        F.lit("observed").alias("observation_type"),
    )
