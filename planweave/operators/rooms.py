"""Rooms as faces of a plan's wall graph, openings on walls, and material colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.geometry import ring_area
from planweave.functions.text import rgba
from planweave.operators.faces import framed_faces, joined_footprints, ring_size
from planweave.operators.outlines import ROOF_TYPES, ROOFS, outlined, small_roofs
from planweave.operators.plane import plan_by_plan

#: Snapping grid, smallest room and largest share of the drawing that a room may cover.
GRID, LEAST_AREA, LARGEST_SHARE = 5, 800.0, 0.45
#: Fewest walls, segments and rooms of a plan whose rooms are taken from its walls.
LEAST_WALLS, LEAST_SEGMENTS, LEAST_ROOMS = 6, 3, 2


def planar_rooms(walls: DataFrame, least_walls: int = LEAST_WALLS, least_segments: int = LEAST_SEGMENTS, least_rooms: int = LEAST_ROOMS) -> DataFrame:
    """(plan_id, room, ring, area, place): the polygons that each plan's snapped wall centrelines enclose, within the area limits.
    Rooms are numbered in the order of their least edges, before the limits; ``place`` is their rank by area, largest first.

    ``walls`` has plan_id, x1, y1, x2, y2, and width and height of the drawing. Holes are no part of a room's area, dead ends and bridges no
    part of its ring. A plan with fewer walls, segments of some length after snapping, or rooms than the least numbers has none.
    """
    snap = lambda c: (F.bround(F.col(c) / GRID) * GRID).cast("long").alias(c)
    ends = ("x1", "y1", "x2", "y2")
    of_plan = Window.partitionBy("plan")
    some = F.count_if((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2"))).over(of_plan)
    snapped = walls.select(F.col("plan_id").alias("plan"), *map(snap, ends), "width", "height")
    sized = snapped.withColumn("walls", F.count("*").over(of_plan)).withColumn("segments", some)
    enough = sized.filter((F.col("walls") >= least_walls) & (F.col("segments") >= least_segments))
    found = framed_faces(enough.select("plan", *ends, "width", "height")).withColumnRenamed("plan", "plan_id")
    by_plan = Window.partitionBy("plan_id")
    number = F.row_number().over(by_plan.orderBy("first"))
    rooms = found.withColumn("room", F.concat(F.lit("room-"), number.cast("string"))).withColumn("number", number)
    rooms = rooms.filter((F.col("area") >= LEAST_AREA) & (F.col("area") <= LARGEST_SHARE * F.col("width") * F.col("height")))
    rooms = rooms.withColumn("rooms", F.count("*").over(by_plan)).filter(F.col("rooms") >= least_rooms)
    ring = F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    place = F.row_number().over(by_plan.orderBy(F.desc("area"), "number"))
    return rooms.select("plan_id", "room", ring.alias("ring"), "area", place.alias("place"))


def roof_outlines(rooms: DataFrame, px_per_meter: Column, low: float, height: float, overhang: float = 0.15, least_area: float = 0.01, small: int | None = None) -> DataFrame:
    """(plan_id, footprint, area, outline, outline_area, vertices, faces, low, high): the union of each plan's rooms (plan_id, ring in whole pixels, which don't overlap) as the
    outer ring of its largest part, in metres with y upwards, its area, that ring moved outwards by ``overhang``, and the size and heights of the slab of ``height`` drawn
    over it on top of ceilings at ``low``.

    Rooms of at most ``least_area`` square metres count for nothing. Metres are counted from the least x and the largest y of the plan's rooms.
    ``px_per_meter`` is a column of ``rooms``, one value a plan. Plans whose rings have at most ``small`` corners are worked on many at a time, in one pass over all rooms.
    """
    rows = rooms.select(F.col("plan_id").alias("plan"), "ring", px_per_meter.cast("double").alias("scale"))
    kernel = lambda number, part: small_roofs(number, part, least_area)
    found, large = plan_by_plan(rows, kernel, ROOFS, ROOF_TYPES, small, ring_size())
    if not large.isEmpty():
        frame = large.groupBy(F.col("plan").alias("__plan")).agg(F.min(F.array_min("ring.x")).cast("long").alias("min_x"), F.max(F.array_max("ring.y")).cast("long").alias("max_y"), F.max("scale").alias("scale"))
        counted = large.filter(ring_area(F.col("ring")) / (F.col("scale") * F.col("scale")) > least_area)
        found = found.unionByName(joined_footprints(counted.select("plan", "ring")).join(frame, F.col("plan").eqNullSafe(F.col("__plan"))).drop("__plan"))
    return outlined(found.withColumnRenamed("plan", "plan_id"), overhang, low, height)


def contour_walls(boxes: DataFrame) -> DataFrame:
    """Boxes (area, w, h) that are walls: 200 pixels or more, three times as long as wide, at most 80 wide and at least 15 long."""
    long, wide = F.greatest("w", "h"), F.least("w", "h")
    return boxes.filter((F.col("area") >= 200) & (long / F.greatest(wide, F.lit(1)) >= 3) & (wide <= 80) & (long >= 15))


def opening_kind(gaps: DataFrame, arcs: DataFrame, cell: int = 64) -> DataFrame:
    """Gaps (plan_id, gap_id, cx, cy, width_px) with kind and confidence: a door where an arc's centre lies closer
    than 1.5 widths, else a window. An existence test, so several arcs count once.

    An arc stands in one cell of its plan, a gap in all cells that its reach covers, so a plan with very many of both is spread
    over its cells; gaps that met a near arc are told by their columns.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    names, reach = ["plan_id", "gap_id", "cx", "cy", "width_px"], 1.5 * F.greatest(F.col("width_px"), F.lit(0))
    cells = lambda c: F.explode(F.sequence(at(F.col(c) - reach), at(F.col(c) + reach)))
    a = arcs.select(F.col("plan_id").alias("__plan"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), at(F.col("cx")).alias("__ax"), at(F.col("cy")).alias("__ay"))
    spread = gaps.select(*names).distinct().withColumn("__x", cells("cx")).withColumn("__y", cells("cy"))
    near = F.sqrt((F.col("cx") - F.col("ax")) ** 2 + (F.col("cy") - F.col("ay")) ** 2) < 1.5 * F.col("width_px")
    met = spread.join(a, (F.col("plan_id") == F.col("__plan")) & (F.col("__x") == F.col("__ax")) & (F.col("__y") == F.col("__ay")) & near, "left_semi")
    doors = met.select(*[F.col(c).alias(f"__{c}") for c in names]).distinct()
    same = F.lit(True)
    for c in names:
        same = same & (F.col(c) == F.col(f"__{c}"))
    door = F.col("__gap_id").isNotNull()
    return gaps.join(doors, same, "left").select("plan_id", "gap_id", F.when(door, "door").otherwise("window").alias("kind"), F.when(door, 0.8).otherwise(0.7).alias("confidence"))


def on_walls(openings: DataFrame, walls: DataFrame, default_px: float = 10) -> DataFrame:
    """The openings (plan_id, wall_id, ...) with the thickness_px of the wall of that id; the first such wall's, and
    the default where there is none."""
    first = walls.groupBy("plan_id", "wall_id").agg(F.min_by("thickness_px", "position").alias("__px"))
    return openings.join(first, ["plan_id", "wall_id"], "left").withColumn("thickness_px", F.coalesce("__px", F.lit(default_px))).drop("__px")


def labelled(rooms: DataFrame, labels: DataFrame) -> DataFrame:
    """The rooms (plan_id, room, label, ...) with the labels (plan_id, room, label) of that id, their own where there is none."""
    new = labels.select("plan_id", "room", F.col("label").alias("__label"))
    return rooms.join(new, ["plan_id", "room"], "left").withColumn("label", F.coalesce("__label", "label")).drop("__label")


def plausible_openings(openings: DataFrame, px_per_meter: Column) -> DataFrame:
    """Openings of 0.5 to 2.5 metres; all of them where the scale is missing or not positive."""
    return openings.filter(plausible(F.col("width_px"), px_per_meter))


def plausible(width_px: Column, px_per_meter: Column) -> Column:
    return px_per_meter.isNull() | (px_per_meter <= 0) | F.try_divide(width_px, px_per_meter).between(0.5, 2.5)


def surface_colors(surfaces: DataFrame, rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """(surface, rgba): the rule's colour, else the default's, else gray. One row a surface in both tables."""
    joined = surfaces.join(rules.select("surface", F.col("color_hex").alias("__rule")), "surface", "left").join(defaults.select("surface", F.col("color_hex").alias("__default")), "surface", "left")
    return joined.select("surface", rgba(F.coalesce("__rule", "__default", F.lit(""))).alias("rgba"))
