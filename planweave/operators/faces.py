"""Faces of plane graphs, whole: rings traced by doubling, spurs and bridges pruned, holes cut out, outlines of unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.operators.outlines import UNION_TYPES, UNIONS, small_unions
from planweave.operators.plane import FACE_TYPES, FACES, FRAMED, FRAMED_TYPES, plan_by_plan, small_faces, small_framed_faces
from planweave.sources.scratch import Round

#: Width of the columns in which edges below a point are looked for.
COLUMN = 128


def cycles(edges: DataFrame) -> DataFrame:
    """(h, face, off): the ring of each directed edge (plan, h, ax, ay, bx, by; h tells all edges apart), named by its least h, and the
    steps from the edge to that one.

    From its end a ring goes on along the edge that leaves there next clockwise from the way back, which a window over each corner's
    edges finds.
    """
    way = lambda x1, y1, x2, y2: F.atan2((F.col(y2) - F.col(y1)).cast("double"), (F.col(x2) - F.col(x1)).cast("double"))
    leaves = edges.select("plan", F.col("ax").alias("x"), F.col("ay").alias("y"), way("ax", "ay", "bx", "by").alias("angle"), F.lit(1).alias("leaves"), "h")
    comes = edges.select("plan", F.col("bx").alias("x"), F.col("by").alias("y"), way("bx", "by", "ax", "ay").alias("angle"), F.lit(0).alias("leaves"), "h")
    corner = Window.partitionBy("plan", "x", "y").orderBy("angle", "leaves", "h")
    out = F.last(F.when(F.col("leaves") == 1, F.col("h")), ignorenulls=True)
    ahead = F.coalesce(out.over(corner.rowsBetween(Window.unboundedPreceding, -1)), out.over(corner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ringed(leaves.unionByName(comes).withColumn("next", ahead).filter("leaves = 0").select("h", "next"))


def ringed(start: DataFrame) -> DataFrame:
    """(h, face, off): the ring of each edge, where ``start`` (h, next) says which edge follows; each edge follows one.

    What lies ahead is looked at 1, 2, 4, ... steps far, each round joining every edge to the one that it
    points to, until no ring's least edge changes; so a ring of n edges takes log n joins, and no ring stands in one task.
    """
    best = F.struct(F.col("h").alias("face"), F.lit(0).cast("long").alias("off"))
    now, steps = Round(start.select("h", "next", best.alias("best"))), 1
    while True:
        there = now.table.select(F.col("h").alias("next"), F.col("next").alias("after"), F.col("best").alias("theirs"))
        further = F.struct(F.col("theirs.face").alias("face"), (F.col("theirs.off") + steps).alias("off"))
        met = now.table.join(there, "next").select("h", F.col("after").alias("next"), F.least("best", further).alias("best"), (F.col("theirs.face") < F.col("best.face")).alias("moved"))
        new = Round(met)
        now.drop()
        now, steps = new, 2 * steps
        if now.table.filter("moved").isEmpty():
            return now.table.select("h", "best.face", "best.off")


def graph(segments: DataFrame) -> DataFrame:
    """(plan, k, ax, ay, bx, by): the different segments (plan, x1, y1, x2, y2) of some length, numbered by k, either way round the same."""
    a, b = F.struct(F.col("x1").cast("long").alias("x"), F.col("y1").cast("long").alias("y")), F.struct(F.col("x2").cast("long").alias("x"), F.col("y2").cast("long").alias("y"))
    ends = segments.select("plan", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    # written, as a number must not change when a task runs again
    return Round(ends.select("plan", F.monotonically_increasing_id().alias("k"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))).table


def half_edges(edges: DataFrame) -> DataFrame:
    """Each edge in both directions: h is 2 k from a to b, and 2 k + 1 back."""
    way = lambda h, *c: F.struct((2 * F.col("k") + h).alias("h"), *[F.col(n).alias(m) for n, m in zip(c, ("ax", "ay", "bx", "by"), strict=True)])
    both = F.array(way(0, "ax", "ay", "bx", "by"), way(1, "bx", "by", "ax", "ay"))
    return edges.select("plan", F.explode(both).alias("e")).select("plan", "e.*")


def traced(segments: DataFrame) -> DataFrame:
    """(plan, h, ax, ay, bx, by, face, off): the directed edges of a plane graph that lie on rings.

    An edge with one face on both sides is a bridge or leads to a dead end; all of these go at once, as those that stay
    form rings with or without them, and the rings are traced anew.
    """
    edges = graph(segments)
    found = cycles(half_edges(edges))
    sides = found.groupBy(F.expr("h div 2").alias("k")).agg((F.min("face") != F.max("face")).alias("parts"))
    loose = sides.filter("NOT parts").select("k")
    if not loose.isEmpty():
        edges = edges.join(loose, "k", "left_anti")
        found = cycles(half_edges(edges))
    return half_edges(edges).join(found, "h")


CROSS = "ax * by - bx * ay"


def below(points: DataFrame, edges: DataFrame, column: int = COLUMN) -> DataFrame:
    """``points`` (plan, x, y, ...) with ``hit``, the face above the edge next below each point, null without one. ``edges`` are
    directed edges with their ``face`` on the left.

    Edges and points meet in columns of the plan; an edge covers its start and not its end, and vertical ones none.
    """
    at = lambda c: F.floor(F.col(c) / column).cast("long")
    over = edges.filter("bx > ax").select(F.col("plan").alias("__plan"), "ax", "ay", "bx", "by", "face", F.explode(F.sequence(at("ax"), at("bx"))).alias("__over"))
    rise = F.expr("ay + (by - ay) * (x - ax) / CAST(bx - ax AS DOUBLE)")
    under = F.expr("ax <= x AND x < bx AND (ay - y) * (bx - ax) + (by - ay) * (x - ax) < 0")
    asked = Round(points.withColumn("__point", F.monotonically_increasing_id())).table
    met = asked.withColumn("__column", at("x")).join(over, F.col("plan").eqNullSafe(F.col("__plan")) & (F.col("__column") == F.col("__over"))).filter(under)
    slope = F.expr("(by - ay) / CAST(bx - ax AS DOUBLE)")
    best = met.groupBy("__point").agg(F.max_by("face", F.struct(rise, slope)).alias("hit"))
    return asked.join(best, "__point", "left").drop("__point")


def rings_of(edges: DataFrame) -> DataFrame:
    """(face, ring): the corners of each face's edges (face, off, ax, ay) in their order, from its least edge."""
    step = F.struct(F.when(F.col("off") == 0, F.lit(-(1 << 62))).otherwise(-F.col("off")).alias("at"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    corners = F.transform(F.array_sort(F.collect_list(step)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return edges.groupBy("face").agg(corners.alias("ring"))


def outer_rings(edges: DataFrame) -> DataFrame:
    """(face, ring): the corners of each face's outer ring (edges: face, off, h, ax, ay, bx, by; enclosed area on the left).

    Where a ring comes to a corner again, it encloses a part there that touches it: the way back to the corner is closed to a ring of its own, at all
    corners at once, and of the rings that come about the one around the others is the outer one.
    """
    again = edges.groupBy("face", "bx", "by").agg(F.count("*").alias("n")).filter("n > 1").select("face").distinct()
    if again.isEmpty():
        return rings_of(edges)
    some = edges.join(again, "face", "left_semi")
    length = some.groupBy("face").agg((F.max("off") + 1).alias("length"))
    after = some.select("face", F.col("off").alias("next_off"), F.col("h").alias("next"))
    some = some.join(length, "face").withColumn("next_off", F.when(F.col("off") > 0, F.col("off") - 1).otherwise(F.col("length") - 1)).join(after, ["face", "next_off"])
    visits = Window.partitionBy("face", "bx", "by").orderBy(F.when(F.col("off") == 0, F.lit(-(1 << 62))).otherwise(-F.col("off")))
    last = F.last("next").over(visits.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = ringed(some.withColumn("closed", F.coalesce(F.lag("next").over(visits), last)).select("h", F.col("closed").alias("next")))
    parts = Round(some.select("face", "h", "ax", "ay", "bx", "by").join(parts.withColumnRenamed("face", "part"), "h")).table
    outer = parts.groupBy("face", "part").agg(F.sum(F.expr(CROSS)).alias("double")).filter("double > 0").select(F.col("face").alias("whole"), "part")
    drawn = rings_of(parts.join(outer.select("part"), "part", "left_semi").select(F.col("part").alias("face"), "off", "ax", "ay"))
    split = drawn.join(outer, F.col("face") == F.col("part")).select(F.col("whole").alias("face"), "ring")
    return rings_of(edges.join(again, "face", "left_anti")).unionByName(split)


def faces(segments: DataFrame, small: int | None = None) -> DataFrame:
    """(plan, ring, area, first): the polygons that the segments (plan, x1, y1, x2, y2; whole numbers, meeting at their ends only) enclose.

    ``ring`` is the outer ring (array of struct<x, y>, against the clock where y points up), ``area`` its area less the holes', ``first`` its least edge. Spurs and
    bridges are left out; what lies inside without touching is a hole of the smallest ring around it, and a polygon itself.

    Plans of at most ``small`` segments are traced many at a time in one pass over all segments; only larger ones go through the joins.
    """
    made, large = plan_by_plan(segments.select("plan", "x1", "y1", "x2", "y2"), small_faces, FACES, FACE_TYPES, small)
    return made if large.isEmpty() else made.unionByName(joined_faces(large))


def framed_faces(segments: DataFrame, small: int | None = None) -> DataFrame:
    """``faces`` of segments that carry their plan's width and height, with these."""
    double = [F.col(c).cast("double").alias(c) for c in ("width", "height")]
    made, large = plan_by_plan(segments.select("plan", "x1", "y1", "x2", "y2", *double), small_framed_faces, FRAMED, FRAMED_TYPES, small)
    if large.isEmpty():
        return made
    size = large.groupBy(F.col("plan").alias("__plan")).agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return made.unionByName(joined_faces(large).join(size, F.col("plan").eqNullSafe(F.col("__plan"))).drop("__plan"))


def joined_faces(segments: DataFrame) -> DataFrame:
    """``faces`` by joins alone, so that no plan stands in one task."""
    edges = Round(traced(segments)).table
    rings = edges.groupBy("plan", "face").agg(F.sum(F.expr(CROSS)).alias("double"), F.min(F.struct("ax", "ay", "bx", "by")).alias("first"), F.count("*").alias("n"))
    rings = Round(rings).table
    shells, outer = rings.filter("double > 0"), rings.filter("double < 0")
    # only plans of several parts can have holes
    several = outer.groupBy("plan").agg(F.count("*").alias("parts")).filter("parts > 1").select(F.col("plan").alias("__plan"))
    same = F.col("plan").eqNullSafe(F.col("__plan"))
    cut = nested(outer.join(several, same, "left_semi"), edges.join(several, same, "left_semi"), shells)
    drawn = outer_rings(edges.join(shells.select("face"), "face"))
    whole = shells.join(drawn, "face").join(cut, F.col("face") == F.col("shell"), "left")
    return whole.select("plan", "ring", ((F.col("double") + F.coalesce("cut", F.lit(0))) / 2).alias("area"), "first")


def nested(outlines: DataFrame, edges: DataFrame, shells: DataFrame) -> DataFrame:
    """(shell, cut): twice the area, as a negative number, of the outlines (plan, face, first, double) that lie directly within each ring of ``shells``.

    The edge next below an outline's least corner has the ring around it above, or belongs to another outline, which then lies in the same ring:
    its answer is taken over, until none changes.
    """
    corners = outlines.select("plan", F.col("face").alias("hole"), F.col("first.ax").alias("x"), F.col("first.ay").alias("y"), "double")
    now = Round(below(corners, edges).filter("hit IS NOT NULL").select("hole", "double", "hit"))
    others = outlines.select(F.col("face").alias("hit"), F.lit(True).alias("open"))
    while True:
        next_ = now.table.select(F.col("hole").alias("hit"), F.col("hit").alias("on"))
        moved = now.table.join(others, "hit", "left").join(next_, "hit", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        # an outline with nothing below it ends the way: there is no ring around
        moved = moved.filter("NOT open OR on IS NOT NULL").select("hole", "double", F.when(F.col("open"), F.col("on")).otherwise(F.col("hit")).alias("hit"), "open")
        new = Round(moved)
        now.drop()
        now = new
        if now.table.filter("open").isEmpty():
            return now.table.join(shells.select(F.col("face").alias("hit")), "hit", "left_semi").groupBy(F.col("hit").alias("shell")).agg(F.sum("double").alias("cut"))


def boundary(rings: DataFrame) -> DataFrame:
    """(plan, ax, ay, bx, by): the edges around the union of rings (plan, ring: array of struct<x, y> of whole numbers up to 65,536) that don't overlap,
    with the inside on their left.

    Edges on one straight line meet in a window: each adds one at its start and takes one away at its end, so the sum along the line is the direction in
    which it is gone along, and nought where edges of neighbours cancel, also where they cover each other in part only.
    """
    ring, n = F.col("ring"), F.size("ring")
    point = lambda i: F.struct(ring[i]["x"].cast("long").alias("x"), ring[i]["y"].cast("long").alias("y"))
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(point(i).alias("a"), point((i + 1) % n).alias("b")))
    turned = F.aggregate(each, F.lit(0).cast("long"), lambda t, e: t + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) < 0
    edges = rings.filter(n >= 3).select("plan", turned.alias("turned"), F.explode(each).alias("e")).filter("e.a <> e.b")
    a, b = F.when(F.col("turned"), F.col("e.b")).otherwise(F.col("e.a")), F.when(F.col("turned"), F.col("e.a")).otherwise(F.col("e.b"))
    edges = edges.select("plan", a.alias("a"), b.alias("b")).withColumn("dx", F.expr("b.x - a.x")).withColumn("dy", F.expr("b.y - a.y"))
    # equal fractions of whole numbers are equal doubles
    slope = F.when(F.col("dx") != 0, F.col("dy") / F.col("dx"))
    meets = F.when(F.col("dx") != 0, F.expr("(dx * a.y - dy * a.x) / dx")).otherwise(F.col("a.x").cast("double"))
    ends = F.array(F.struct(F.col("a").alias("p"), F.lit(1).alias("d")), F.struct(F.col("b").alias("p"), F.lit(-1).alias("d")))
    events = edges.select("plan", (slope + 0.0).alias("slope"), (meets + 0.0).alias("meets"), F.explode(ends).alias("e"))
    events = events.groupBy("plan", "slope", "meets", "e.p").agg(F.sum("e.d").alias("d"))
    along = Window.partitionBy("plan", "slope", "meets").orderBy("p")
    covered = events.withColumn("net", F.sum("d").over(along)).withColumn("q", F.lead("p").over(along)).filter("net <> 0 AND q IS NOT NULL")
    a, b = F.when(F.col("net") > 0, F.col("p")).otherwise(F.col("q")), F.when(F.col("net") > 0, F.col("q")).otherwise(F.col("p"))
    return covered.select("plan", a.alias("a"), b.alias("b")).select("plan", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def footprints(rings: DataFrame, small: int | None = None) -> DataFrame:
    """(plan, ring, area): the outer ring of the union of each plan's rings (plan, ring) and its area less its holes; the largest part, where the union has
    several (of equals the one with the least corner). Corners are those where the outline turns. Plans whose rings have at most ``small`` corners are put together many at
    a time, in one pass over all rings; only larger ones go through joins."""
    made, large = plan_by_plan(rings.select("plan", "ring"), small_unions, UNIONS, UNION_TYPES, small, ring_size())
    return made if large.isEmpty() else made.unionByName(joined_footprints(large))


def ring_size() -> Column:
    return F.greatest(F.size("ring"), F.lit(1))


def joined_footprints(rings: DataFrame) -> DataFrame:
    """``footprints`` by joins alone, so that no plan stands in one task."""
    # written, as a number must not change when a task runs again
    edges = Round(boundary(rings).withColumn("h", F.monotonically_increasing_id())).table
    edges = Round(edges.join(cycles(edges), "h")).table
    found = edges.groupBy("plan", "face").agg(F.sum(F.expr(CROSS)).alias("double"), F.min(F.struct("ax", "ay", "bx", "by")).alias("first"))
    found = Round(found).table
    shells = found.filter("double > 0")
    cut = nested(found.filter("double < 0"), edges, shells)
    sized = shells.join(cut, F.col("face") == F.col("shell"), "left").withColumn("double", F.col("double") + F.coalesce("cut", F.lit(0)))
    best = sized.groupBy("plan").agg(F.min_by(F.struct("face", "double"), F.struct(-F.col("double"), "first")).alias("b")).select("plan", "b.face", (F.col("b.double") / 2).alias("area"))
    drawn = outer_rings(edges.join(best.select("face"), "face"))
    return best.join(drawn, "face").select("plan", turning(F.col("ring")).alias("ring"), "area")


def turning(ring: Column) -> Column:
    """The corners of a ring at which it turns."""
    n = F.size(ring)

    def turns(p: Column, i: Column) -> Column:
        before, after = ring[(i + n - 1) % n], ring[(i + 1) % n]
        return (p["x"] - before["x"]) * (after["y"] - p["y"]) - (p["y"] - before["y"]) * (after["x"] - p["x"]) != 0

    return F.filter(ring, turns)
