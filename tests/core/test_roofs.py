"""Roofs of many small plans at once, against joins and column expressions."""

import random

from pyspark.sql import functions as F

from planweave.functions.geometry import offset_ring, ring_area, roof_solid
from planweave.operators.faces import footprints
from planweave.operators.rooms import roof_outlines
from planweave.plans import drawing


def rooms(rnd, plans):
    """Cells of grids either way round, some cut along their diagonal, with holes and parts that touch at corners only; rings that are no rooms."""
    for plan in [None, *range(plans)]:
        side, x0, y0 = rnd.choice([20, 30]), rnd.randint(-50, 50), rnd.randint(-50, 50)
        for x in range(rnd.randint(1, 6)):
            for y in range(rnd.randint(1, 6)):
                corners = [(x0 + side * (x + i), y0 + side * (y + j)) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]
                kind = rnd.random()
                if kind < 0.65:
                    yield plan, corners if kind < 0.3 else corners[::-1]
                elif kind < 0.75:
                    yield plan, corners[:3]
                    yield plan, [corners[0], *corners[2:]]
                elif kind < 0.85:
                    yield plan, [*corners[:2], corners[1], *corners[2:]]
        yield plan, rnd.choice([None, [], [(x0 - 9, y0)], [(x0, y0 - 40), (x0 + 1, y0 - 40), (x0, y0 - 39)]])


def test_roofs_of_small_plans_equal_joins_and_expressions(spark):
    df = spark.createDataFrame(list(rooms(random.Random(7), 40)), "plan_id int, ring array<struct<x:int,y:int>>").repartition(3)
    scale = F.lit(10.0)
    made = roof_outlines(df, scale, 3.25, 0.2).cache()
    value = lambda df: sorted(((str(r.plan_id), r.footprint, r.area, r.outline) for r in df.collect()), key=repr)
    found = value(made)
    assert len(found) > 30
    # the order of a ring's corners begins with its least edge in one, with any in the other
    turned = lambda rows: [(p, {tuple(c) for c in f}, len(f), round(a, 9), {(round(c.x, 9), round(c.y, 9)) for c in o}) for p, f, a, o in rows]
    for small in (0, 40):
        assert turned(value(roof_outlines(df, scale, 3.25, 0.2, small=small))) == turned(found)
    solid = roof_solid(offset_ring(F.col("footprint"), 0.15), F.lit(3.25), F.lit(0.2))
    both = made.select("*", offset_ring(F.col("footprint"), 0.15).alias("o"), solid.alias("s")).withColumn("a", ring_area(F.col("o")))
    for r in both.collect():
        assert len(r.o) == len(r.outline) and all(abs(p.x - q.x) + abs(p.y - q.y) < 1e-9 for p, q in zip(r.o, r.outline, strict=True))
        assert abs(r.a - r.outline_area) < 1e-9
        assert (len(r.s.vertices), len(r.s.faces), min(v[2] for v in r.s.vertices), max(v[2] for v in r.s.vertices)) == (r.vertices, r.faces, r.low, r.high)
    plain = df.filter("plan_id IS NOT NULL").withColumnRenamed("plan_id", "plan")
    part = lambda small: sorted((r.plan, {tuple(c) for c in r.ring}, r.area) for r in footprints(plain, small).collect())
    assert part(None) == part(0)


def test_slabs_are_made_of_the_same_triangles(spark):
    import numpy as np

    from planweave.operators.outlines import Corners, slabs

    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)], [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)], [(0.0, 0.0), (3.0, 0.0), (4.0, 1.0), (3.0, 3.0), (0.0, 3.0)]]
    x, y = (np.array([p[k] for r in rings for p in r]) for k in (0, 1))
    vertices, faces, n, m = slabs(Corners(np.array(list(map(len, rings)))), x, y, 3.25, 3.45)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, ring array<struct<x:double,y:double>>")
    for r in df.select("i", roof_solid(F.col("ring"), F.lit(3.25), F.lit(0.2)).alias("s")).collect():
        assert r.s.vertices == vertices[sum(n[: r.i]) :][: n[r.i]].tolist()
        assert r.s.faces == faces[sum(m[: r.i]) :][: m[r.i]].tolist()


def test_rooms_move_once(spark):
    # a plan's rooms are together already: their edges need not meet along lines in one shuffle after another
    spark.sparkContext.setJobGroup("roof", "roof")
    assert drawing.roof_outline(spark, "/root/testdata/sf0.001").count() > 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("roof")) <= 7
