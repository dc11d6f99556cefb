"""Hand-computed cases of functions and operators, and folds against plain loops."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from planweave.functions import geometry as G
from planweave.functions import openings as O
from planweave.functions import text as T
from planweave.functions.canonical import canonical_json, fingerprint
from planweave.functions.geometry import offset_ring, ring_area, roof_solid
from planweave.operators.faces import faces, footprints
from planweave.operators.intervals import dedupe_walls, greedy_pairs, merge_collinear
from planweave.operators.latest import next_sequence, replay_since
from planweave.operators.regions import free_rooms
from planweave.operators.rooms import contour_walls, on_walls, opening_kind, planar_rooms, plausible_openings, surface_colors
from planweave.operators.runs import boundary_open, line_numbers, wall_gaps, word_lines
from planweave.operators.scale import chosen_scale, fallback_scale, last_materials, last_value, overall_confidence, plan_flags, rank_matched_scale, scale_from_area, scale_from_rooms
from planweave.sources import blobs


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("BEDROOM 11'4\" x 10'7\"", (3.4544, 3.2258, 11.1432035)), ("12 x 14", (3.6576, 4.2672, 15.6077)), ("no size", None), ("100' x 10'", None)])
def test_room_dimension(spark, text, want):
    got = one(spark, T.room_dimension(F.col("t")), t=text)
    assert got is None if want is None else tuple(got) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(("text", "want"), [("SQFT 572", 572), ("572 sq ft", 572), ("SQFT 40", None), ("", None)])
def test_square_feet(spark, text, want):
    assert one(spark, T.square_feet(F.col("t")), t=text) == want


def test_ceiling(spark):
    assert one(spark, T.ceiling_height(F.col("t")), t="CEILING HEIGHT 9'11\"") == 3.02


@pytest.mark.parametrize(("text", "want"), [("Kitchenette", "kitchenette"), ("LIVING/DINING", "living_dining"), ("CL", "closet"), ("clerk", "unknown"), ("ref", "ref"), ("reference", "unknown")])
def test_room_type(spark, text, want):
    assert one(spark, T.room_type(F.col("t")), t=text) == want


@pytest.mark.parametrize(("color", "want"), [("#E5E1D8", [229, 225, 216, 255]), ("#FFF", [200, 200, 200, 255]), ("A0D2F0", [160, 210, 240, 255])])
def test_rgba(spark, color, want):
    assert one(spark, T.rgba(F.col("c")), c=color) == want


def test_names(spark):
    assert one(spark, T.safe_name(F.col("n")), n="a b/ç.pdf") == "a_b_ç.pdf"
    assert one(spark, T.first_page_key(F.col("n")), n="k/a.pdf") == "k/a_page1.png"


RING = [Row(x=0.0, y=0.0), Row(x=400.0, y=0.0), Row(x=400.0, y=300.0), Row(x=0.0, y=300.0)]


def test_rings_and_meters(spark):
    assert one(spark, G.ring_area(F.col("r")), r=RING) == 120000
    assert tuple(one(spark, G.centroid(F.col("r")), r=RING)) == (200, 150)
    assert tuple(one(spark, G.to_meters(F.lit(0), F.lit(0), F.lit(0), F.lit(600), F.lit(40)), i=1)) == (0, 15)
    assert tuple(one(spark, G.to_meters(F.lit(400), F.lit(300), F.lit(0), F.lit(600), F.lit(40)), i=1)) == (10, 7.5)
    assert one(spark, G.overlap_ratio(F.lit(0), F.lit(100), F.lit(50), F.lit(250)), i=1) == 0.25
    assert one(spark, G.angle(F.lit(-1), F.lit(1)), i=1) == 135
    assert [one(spark, G.snap(F.lit(v)), i=1) for v in (12, 13)] == [10, 15]


@pytest.mark.parametrize(("px", "want"), [(6, 0.15), (1, 0.05), (40, 0.8), (None, 0.15)])
def test_wall_thickness(spark, px, want):
    assert one(spark, G.wall_thickness(F.lit(px).cast("double"), F.lit(40.0)), i=1) == pytest.approx(want)


def test_solids(spark):
    mesh = one(spark, G.extruded(F.col("r"), F.lit(0.0), F.lit(3.0)), r=RING)
    assert len(mesh["vertices"]) == 8 and len(mesh["faces"]) == 12 and {i for f in mesh["faces"] for i in f} == set(range(8))
    edges = [tuple(sorted((f[i], f[(i + 1) % 3]))) for f in mesh["faces"] for i in range(3)]
    assert all(edges.count(e) == 2 for e in edges)
    quad = one(spark, G.wall_quad(F.col("a"), F.col("b"), F.lit(2.0)), a=Row(x=0.0, y=0.0), b=Row(x=10.0, y=0.0))
    assert {(p["x"], p["y"]) for p in quad} == {(0, 1), (10, 1), (10, -1), (0, -1)}


def test_scales(spark):
    assert one(spark, scale_from_area(F.lit(572), F.lit(800), F.lit(600)), i=1) == pytest.approx(79.517692)
    assert one(spark, fallback_scale(F.lit(120000.0), F.lit(800)), i=1) == 40
    assert one(spark, overall_confidence(F.lit(0.85), F.lit(2), F.lit(0)), i=1) == 0.3
    assert tuple(one(spark, chosen_scale(F.lit(7.0), F.lit(0.3), F.lit(9.0), F.lit(0.35)), i=1)) == (9.0, 0.35)
    drawn = spark.createDataFrame([("p", 1, 2000.0), ("p", 2, 1000.0), ("p", 3, 500.0)], "plan string, id int, px double")
    real = spark.createDataFrame([("p", 1, 20.0), ("p", 2, 10.0)], "plan string, id int, m double")
    assert tuple(rank_matched_scale(drawn, real, ["plan"], "px", "m", ("id", "id")).first()) == ("p", 10.0, 0.7)


def test_rule_folding(spark):
    rules = spark.createDataFrame([(1, "floor_height", 2.8), (2, "floor_height", None), (3, "glazing", 0.5), (4, "glazing", None)], "pos int, kind string, v double")
    kind, value, pos = F.col("kind"), F.col("v"), F.col("pos")
    got = rules.agg(last_value(kind, value, pos, "floor_height", F.lit(3.0), True), last_value(kind, value, pos, "glazing", F.lit(0.3), False)).first()
    assert tuple(got) == (2.8, 0.3)


def test_lines_and_replay(spark):
    words = spark.createDataFrame([("p", i, y) for i, y in enumerate((10, 25, 44, 70))], "plan string, i int, top int")
    got = line_numbers(words, ["plan"], ["i"], F.col("top"), 20).orderBy("i").collect()
    assert [r.line_no for r in got] == [1, 1, 1, 2]
    events = spark.createDataFrame([("p", i) for i in range(1, 6)], "project string, seq int")
    assert sorted(r.seq for r in replay_since(events, "seq", 3).collect()) == [4, 5]
    assert replay_since(events, "seq", "abc").count() == 5
    assert next_sequence(events, ["project"], "seq").first().next_sequence == 6


def lines(rng, n, places=tuple(range(40)), along=30):
    out = []
    for i in range(n):
        s = rng.randrange(along)
        out.append((1, i, rng.choice(places), s, s + rng.randrange(1, 30), rng.randrange(6)))
    return out


def ratio(a, b):
    return max(0, min(a[4], b[4]) - max(a[3], b[3])) / max(a[4] - a[3], b[4] - b[3], 1)


SCHEMA = "plan int, id long, pos int, s int, e int, thick int"


@pytest.mark.parametrize(("seed", "n", "places", "along"), [*((s, 25, range(40), 30) for s in range(3)), (3, 400, [p for p in range(-200, 400) if p % 50 < 30], 200), (4, 300, range(9), 2000), (5, 300, [7], 60)])
def test_folds_match_plain_loops(spark, seed, n, places, along):
    """Few lines, several islands, a narrow band, one position."""
    rng = random.Random(seed)
    rows = lines(rng, n, places, along)
    df = spark.createDataFrame(rows, SCHEMA)
    order = sorted(rows, key=lambda r: (r[2], r[1]))
    used, pairs = set(), []
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            d = b[2] - a[2]
            if a[1] in used or d > 8:
                break
            if b[1] not in used and d >= 3 and ratio(a, b) >= 0.3:
                used |= {a[1], b[1]}
                pairs.append((a[1], b[1], d))
    assert sorted((r.a, r.b, r.apart) for r in greedy_pairs(df, ["plan"], 3, 8, 0.3).collect()) == sorted(pairs)

    done, extents = set(), []
    for i, a in enumerate(rows):
        if i in done:
            continue
        pos, s, e, n = a[2], a[3], a[4], 1
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if j not in done and abs(pos - b[2]) <= 2 and max(s, b[3]) - min(e, b[4]) <= 5:
                pos, s, e, n = int((pos + b[2]) / 2), min(s, b[3]), max(e, b[4]), n + 1
                done.add(j)
        extents.append((pos, s, e, n))
    assert sorted((r.pos, r.s, r.e, r.n) for r in merge_collinear(df, ["plan"], 5, 2).collect()) == sorted(extents)

    gone, kept = set(), []
    for i, a in enumerate(rows):
        if i in gone:
            continue
        best = a
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if j not in gone and abs(a[2] - b[2]) <= 10 and ratio(a, b) > 0.4:
                gone.add(j)
                best = b if b[5] > best[5] else best
        kept.append((a[1], best[1], best[5]))
    assert sorted((r.seed, r.kept, r.thick) for r in dedupe_walls(df, ["plan"], 10, 0.4).collect()) == sorted(kept)


def test_folds_of_many_lines_of_one_plan_and_of_null_plans(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(None).cast("string").alias("plan"), "id", (F.rand(1) * 2000).cast("int").alias("pos"), (F.rand(2) * 5000).cast("int").alias("s"), F.lit(1).alias("thick"))
    df = df.withColumn("e", F.col("s") + 100).cache()
    pairs = greedy_pairs(df, ["plan"], 3, 20, 0.3).collect()
    assert len({r.a for r in pairs} | {r.b for r in pairs}) == 2 * len(pairs) > n / 2 and {r.plan for r in pairs} == {None}
    extents = merge_collinear(df, ["plan"], 2, 10).collect()
    assert sum(r.n for r in extents) == n and sorted(r.extent for r in extents) == list(range(len(extents)))
    assert dedupe_walls(df, ["plan"], 10, 0.4).count() < n
    assert greedy_pairs(df.limit(0), ["plan"], 3, 20, 0.3).count() == 0


SEGMENTS = "plan int, x1 int, y1 int, x2 int, y2 int"


def regions(size, walled):
    """Plain flood fill: the sizes of the sets of grid cells that no wall parts, but for the one that leads outside."""
    left, out = {(x, y) for x in range(-1, size + 1) for y in range(-1, size + 1)}, []
    while left:
        todo, seen = [left.pop()], 0
        outside = False
        while todo:
            x, y = todo.pop()
            seen += 1
            outside |= x < 0
            for nx, ny, edge in ((x + 1, y, (x + 1, y, x + 1, y + 1)), (x - 1, y, (x, y, x, y + 1)), (x, y + 1, (x, y + 1, x + 1, y + 1)), (x, y - 1, (x, y, x + 1, y))):
                if (nx, ny) in left and edge not in walled:
                    left.remove((nx, ny))
                    todo.append((nx, ny))
        out += [] if outside else [seen]
    return sorted(out)


def test_faces_of_random_grids_equal_flood_fill(spark):
    """Grids with gaps have dead ends, bridges, parts within parts, and holes in holes."""
    rng, rows, want = random.Random(8), [], {}
    for plan in range(12):
        size = rng.randrange(3, 9)
        edges = [(x, y, x + 1, y) for x in range(size) for y in range(size + 1)] + [(x, y, x, y + 1) for x in range(size + 1) for y in range(size)]
        walled = set(rng.sample(edges, int(len(edges) * rng.choice((0.5, 0.7, 0.8, 1.0)))))
        want[plan] = regions(size, walled)
        rows += [(plan, *(10 * v for v in (e if rng.random() < 0.5 else e[2:] + e[:2]))) for e in walled] + [(plan, 0, 0, 0, 0)]
    found = faces(spark.createDataFrame(rows, SEGMENTS)).collect()
    assert {p: sorted(r.area / 100 for r in found if r.plan == p) for p in want} == want
    for r in found:
        ring = [(p.x, p.y) for p in r.ring]
        assert len(ring) >= 4 and len(set(ring)) == len(ring) and sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2 >= r.area
    assert faces(spark.createDataFrame([(1, 0, 0, 10, 0), (1, 10, 0, 10, 10)], SEGMENTS)).count() == 0
    assert faces(spark.createDataFrame([], SEGMENTS)).count() == 0


def test_faces_with_slanting_walls_and_a_long_ring(spark):
    square = lambda x, y, a: [(x, y, x + a, y), (x + a, y, x + a, y + a), (x + a, y + a, x, y + a), (x, y + a, x, y)]
    walls = square(0, 0, 30) + square(10, 10, 10) + [(0, 0, 5, 5), (5, 5, 5, 8)] + [(12, 15, 15, 12), (15, 12, 18, 15), (18, 15, 15, 18), (15, 18, 12, 15)] + square(23, 11, 3) + [(30, 30, 40, 40)] + square(40, 40, 10)
    circle = [(round(2000 * math.cos(math.tau * i / 300)), round(2000 * math.sin(math.tau * i / 300))) for i in range(300)]
    rows = [(1, *w) for w in walls] + [(None, *a, *b) for a, b in zip(circle, circle[1:] + circle[:1], strict=True)]
    found = faces(spark.createDataFrame(rows, SEGMENTS)).collect()
    assert sorted(r.area for r in found if r.plan == 1) == [9, 18, 82, 100, 791]
    (whole,) = [r for r in found if r.plan is None]
    start = circle.index((whole.ring[0].x, whole.ring[0].y))
    assert [(p.x, p.y) for p in whole.ring] == circle[start:] + circle[:start]


def test_rings_that_touch_themselves(spark):
    """Squares that hang on corners inside a room, one on another, and one outside."""
    square = lambda x, y, a: [(x, y, x + a, y), (x + a, y, x + a, y + a), (x + a, y + a, x, y + a), (x, y + a, x, y)]
    walls = square(0, 0, 40) + square(10, 10, 10) + square(20, 20, 5) + square(40, 40, 10)
    turned = [(0, 0, 30, 0), (30, 0, 30, 30), (30, 30, 0, 30), (0, 30, 0, 0), (0, 0, 20, 10), (20, 10, 10, 20), (10, 20, 0, 0)]
    found = faces(spark.createDataFrame([(1, *w) for w in walls] + [(2, *w) for w in turned], SEGMENTS)).collect()
    rings = {(r.plan, r.area): {(p.x, p.y) for p in r.ring} for r in found}
    assert rings[2, 900 - 150] == {(0, 0), (30, 0), (30, 30), (0, 30)} and rings[2, 150] == {(0, 0), (20, 10), (10, 20)}
    assert sorted(r.area for r in found if r.plan == 1) == [25, 100, 100, 1600 - 125] and rings[1, 1475] == {(0, 0), (40, 0), (40, 40), (0, 40)}
    for r in found:
        ring = [(p.x, p.y) for p in r.ring]
        assert len(set(ring)) == len(ring)


def test_footprints_of_random_cells_equal_flood_fill(spark):
    rng, rows, want = random.Random(3), [], {}
    for plan in range(12):
        size = rng.randrange(2, 7)
        cells = {(x, y) for x in range(size) for y in range(size) if rng.random() < 0.65} or {(0, 0)}
        left, best = set(cells), 0
        while left:
            todo, n = [left.pop()], 0
            while todo:
                x, y = todo.pop()
                n += 1
                near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & left
                left -= near
                todo += near
            best = max(best, n)
        want[plan] = best
        for x, y in cells:
            ring = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
            rows.append((plan, [(10 * a, 10 * b) for a, b in (ring if rng.random() < 0.5 else ring[::-1])]))
    # a long side next to two short ones
    rows += [(99, [(0, 0), (40, 0), (40, 10), (0, 10)]), (99, [(0, 10), (15, 10), (15, 30), (0, 30)]), (99, [(15, 10), (40, 10), (15, 30)])]
    df = spark.createDataFrame(rows, "plan int, ring array<struct<x:int,y:int>>")
    found = {r.plan: r for r in footprints(df).collect()}
    assert {p: found[p].area / 100 for p in want} == want
    assert found[99].area == 400 + 300 + 250 and {(p.x, p.y) for p in found[99].ring} == {(0, 0), (40, 0), (40, 10), (15, 30), (0, 30)}
    assert footprints(df.limit(0)).count() == 0


@pytest.mark.parametrize("corners", [True, False])
def test_free_rooms_of_random_grids_equal_flood_fill(spark, corners):
    rng, rows, frames, want = random.Random(5), [], [], {}
    for plan in range(6):
        w, h = rng.randrange(5, 90), rng.randrange(3, 12)
        walls = {(x, y) for x in range(w) for y in range(h) if rng.random() < 0.45}
        left, found = {(x, y) for x in range(w) for y in range(h)} - walls, []
        while left:
            first = min(left, key=lambda p: (p[1], p[0]))
            todo, n = [first], 0
            left.remove(first)
            while todo:
                x, y = todo.pop()
                n += 1
                near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if corners or a == 0 or b == 0} & left
                left -= near
                todo += near
            found.append((-n, first[1], first[0]))
        want |= {(plan, f"room-{k}"): (-n, x, y) for k, (n, y, x) in enumerate(sorted(f for f in found if -f[0] <= 0.45 * w * h and -f[0] >= 2), 1)}
        rows += [(plan, *p) for p in walls] + [(plan, -1, 0), (plan, w, 1)]
        frames.append((plan, w, h))
    got = free_rooms(spark.createDataFrame(rows, "plan int, x int, y int"), spark.createDataFrame(frames, "plan int, width int, height int"), 2, 0.45, corners)
    assert {(r.plan, r.room): (r.area, r.x, r.y) for r in got.collect()} == want


def test_moved_rings(spark):
    rings = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (5, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)], [(0, 0), (12, 0), (0, 5)]]
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in r],) for r in rings], "ring array<struct<x:double,y:double>>")
    got = df.select(offset_ring(F.col("ring"), 0.15).alias("o")).select(F.size("o").alias("n"), ring_area(F.col("o")).alias("a")).collect()
    q = 8 * 0.0225 * math.sin(math.pi / 32)
    assert [(r.n, round(r.a, 9)) for r in got[:2]] == [(68, round(100 + 6 + 4 * q, 9)), (86, round(64 + 6 + 5 * q - 0.0225, 9))]
    assert 30 + 30 * 0.15 + 3.9 * q < got[2].a < 30 + 30 * 0.15 + math.pi * 0.0225
    solid = df.select(roof_solid(offset_ring(F.col("ring"), 0.15), F.lit(3.25), F.lit(0.2)).alias("s")).first().s
    assert {v[2] for v in solid["vertices"]} == {3.25, 3.45} and len(solid["vertices"]) == 2 * 68


def test_rooms_and_openings(spark):
    walls = [("p", *s, 1000, 1000) for s in [(1, 0, 101, 1), (99, 0, 100, 100), (100, 100, 0, 100), (0, 100, 0, 0)]]
    walls += [("q", *s, 500, 500) for s in [(0, 0, 100, 0), (100, 0, 200, 0), (0, 100, 100, 100), (100, 100, 200, 100), (0, 0, 0, 100), (100, 0, 100, 100), (200, 0, 200, 100)]]
    walls = spark.createDataFrame(walls, "plan_id string, x1 int, y1 int, x2 int, y2 int, width int, height int")
    # p has too few walls, and would have too few rooms
    assert [(r.plan_id, r.room, r.area, r.place) for r in planar_rooms(walls).orderBy("place").collect()] == [("q", "room-1", 10000.0, 1), ("q", "room-2", 10000.0, 2)]
    assert [(r.plan_id, r.area) for r in planar_rooms(walls.filter("plan_id = 'p'"), 1, 1, 1).collect()] == [("p", 10000.0)]
    assert planar_rooms(walls, least_rooms=3).count() == 0
    gaps = spark.createDataFrame([("p", 1, 100, 100, 40), ("p", 2, 500, 500, 40)], "plan_id string, gap_id int, cx int, cy int, width_px int")
    arcs = spark.createDataFrame([("p", 159, 100), ("p", 560, 500)], "plan_id string, cx int, cy int")
    assert {r.gap_id: r.kind for r in opening_kind(gaps, arcs).collect()} == {1: "door", 2: "window"}
    widths = spark.createDataFrame([(w,) for w in (19, 20, 100, 101)], "width_px int")
    assert [r.width_px for r in plausible_openings(widths, F.lit(40.0)).collect()] == [20, 100]
    assert plausible_openings(widths, F.lit(None).cast("double")).count() == 4


def test_openings_near_many_arcs(spark):
    rng = random.Random(1)
    gaps = [("p", i, rng.randrange(-300, 300), rng.randrange(-300, 300), rng.choice((0, 5, 40, 200))) for i in range(80)] + [(None, 99, 0, 0, 40)]
    arcs = [("p", rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(40)] + [(None, 0, 0)]
    found = opening_kind(spark.createDataFrame(gaps, "plan_id string, gap_id int, cx int, cy int, width_px int"), spark.createDataFrame(arcs, "plan_id string, cx int, cy int")).collect()
    want = {i: "door" if any(q == p is not None and math.dist((x, y), (ax, ay)) < 1.5 * w for q, ax, ay in arcs) else "window" for p, i, x, y, w in gaps}
    assert {r.gap_id: r.kind for r in found} == want and len(found) == len(gaps)


def test_canonical_text_is_that_of_sorted_json(spark):
    rows = [(1, 'a "q" \\ \n é \U0001f600', 1.5, [[1, 2], None, []], {"b": 2.0, "a": None}, True), (2, None, -3.0, None, {}, None), (3, "", 12345678.0, [], None, False), (4, "x", 0.001, [[None]], {"é": 1e15}, True)]
    df = spark.createDataFrame(rows, "z int, s string, d double, a array<array<int>>, m map<string,double>, b boolean")
    kind = StructType(df.schema.fields)
    got = df.select("z", canonical_json(F.struct(*df.columns), kind).alias("text"), fingerprint(F.struct(*df.columns), kind).alias("hash")).collect()
    for r, row in zip(sorted(got), rows, strict=True):
        text = json.dumps(dict(zip(df.columns, row, strict=True)), sort_keys=True)
        assert r.text == text and r.hash == hashlib.sha256(text.encode()).hexdigest()


def test_colors_and_blobs(spark, tmp_path):
    surfaces = spark.createDataFrame([("walls",), ("floor",), ("roof",)], "surface string")
    rules = spark.createDataFrame([("roof", "#010203")], "surface string, color_hex string")
    got = {r.surface: r.rgba for r in surface_colors(surfaces, rules, blobs.materials(spark)).collect()}
    assert got == {"walls": [200, 200, 200, 255], "floor": [140, 130, 122, 255], "roof": [1, 2, 3, 255]}
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\x03\x20\0\0\x02\x58")
    (tmp_path / "b.txt").write_bytes(b"no image")
    read = blobs.blobs(spark, str(tmp_path)).select("length", blobs.image_size(F.col("content")).alias("size")).collect()
    assert {tuple(r.size) if r.size else None for r in read} == {(800, 600), None}


def test_openings(spark):
    point = lambda x, y: Row(x=float(x), y=float(y))
    assert one(spark, O.on_edge(F.col("p")), p=[point(5, 90), point(60, 90)]) is True
    assert one(spark, O.on_edge(F.col("p")), p=[point(6, 90), point(60, 90), point(0, 0)]) is False
    assert {tuple(c) for c in one(spark, O.gap_rectangle(F.col("a"), F.col("b"), F.lit(4)), a=point(0, 0), b=point(10, 0))} == {(0, 5), (10, 5), (10, -5), (0, -5)}
    assert one(spark, O.gap_rectangle(F.col("a"), F.col("b"), F.lit(4)), a=point(0, 0), b=point(0, 0)) is None
    solid = one(spark, O.opening_solid(F.col("a"), F.col("b"), F.lit(True), F.lit(0.15)), a=point(0, 0), b=point(1, 0))
    assert {round(v[2], 6) for v in solid["vertices"]} == {0.9, 2.1} and {round(v[1], 6) for v in solid["vertices"]} == {0.09, -0.09}
    narrow = one(spark, O.opening_solid(F.col("a"), F.col("b"), F.lit(False), F.lit(0.15)), a=point(0, 0), b=point(0.01, 0))
    assert max(v[0] for v in narrow["vertices"]) - min(v[0] for v in narrow["vertices"]) == pytest.approx(0.84)
    assert {v[2] for v in narrow["vertices"]} == {0.0, 2.1}


@pytest.mark.parametrize(("angle", "want"), [(1.0, 1.0), (90.5, 0.5), (179.0, -1.0), (45.0, 45.0), (135.0, 45.0)])
def test_deskew(spark, angle, want):
    assert one(spark, O.deskew(F.lit(angle)), i=1) == want


def test_scores(spark):
    assert one(spark, O.rotation(F.lit(0.5)), i=1) == 0 and one(spark, O.rotation(F.lit(-0.6)), i=1) == 0.6
    assert one(spark, O.area_accuracy(F.lit(None).cast("double")), i=1) == 1 and one(spark, O.area_accuracy(F.lit(2.0)), i=1) == 0
    assert one(spark, O.fidelity(F.lit(0.5)), i=1) == 0.85
    assert one(spark, O.canvas_scale(F.lit(1400), F.lit(0)), i=1) == 0.5 and one(spark, O.canvas_scale(F.lit(10), F.lit(10)), i=1) == 1


def test_scale_from_rooms(spark):
    ask = lambda area, w, h, known=None: tuple(one(spark, scale_from_rooms(F.col("a"), F.col("w"), F.col("h"), F.lit(known).cast("double")), a=area, w=w, h=h))
    scale, confidence = ask(120000.0, 800, 600)
    assert scale == pytest.approx(53.3333, abs=1e-4) and confidence == 0.35
    assert ask(50.0, 800, 600)[0] == pytest.approx((800 * 600 * 0.6 / max(800 * 600 * 0.6 * (15 / 800) ** 2, 20)) ** 0.5)
    assert ask(120000.0, 800, 600, 30.0)[0] == pytest.approx((120000 / 30) ** 0.5)
    assert ask(0.0, 0, 0) == (50.0, 0.1)


def test_words_make_lines(spark):
    words = spark.createDataFrame([(1, i, t, 5 * i, y, 8, 4) for i, (t, y) in enumerate([("12'", 10), (" x ", 25), ("\t", 99), ("9'", 44), ("BED", 70)])], "plan int, id int, text string, x int, y int, w int, h int")
    got = sorted(map(tuple, word_lines(words, ["plan"], ["id"]).collect()))
    assert got == [(1, 1, "12' x 9'", 0, 10, 23, 38), (1, 2, "BED", 20, 70, 8, 4)]


def test_flags(spark):
    flags = lambda *v: one(spark, plan_flags(*[F.lit(x) for x in v]), i=1)
    assert flags(0.7, 0.65, 0, 2, 0) == ["very_few_walls", "no_rooms_detected"]
    assert flags(0.96, 0.35, 2, 5, 3) == ["very_sparse_content", "scale_uncertain", "2_rooms_have_open_boundaries"]
    assert flags(0.4, 0.5, 0, 3, 1) == ["very_dense_content"]


def test_texts_of_a_drawing(spark):
    of = lambda f, t: one(spark, f(F.col("t")), t=t)
    assert [(round(r["width_m"], 4), round(r["height_m"], 4)) for r in of(T.strict_rooms, "11'4\" x 10'7\" and 11' x 10' or 99'0\" x 1'0\"")] == [(3.4544, 3.2258)]
    assert of(T.last_square_feet, "SQFT 600 then 700 sqft, 40 SQ FT") == 700 and of(T.last_square_feet, "99999999999999 sqft") is None
    assert of(T.last_ceiling_height, "CEILING HEIGHT 9'11\" ceiling height 8’ 0 CEILING HEIGHT 50'0") == 2.44
    assert of(T.room_type, "CL\n") == "closet" and of(T.room_type, "Living & Dining") == "living_dining"
    assert [of(T.is_label, t) for t in ("Bedroom", "5'", "hello")] == [True, True, False]
    assert of(T.without_fences, "```json\n{\"a\": 1}\n``` ") == '{"a": 1}' and of(T.without_fences, " {} ") == "{}"
    assert [of(T.extension, t) for t in ("a.B.PDF", "none", "x.")] == ["pdf", "bin", ""]
    assert [of(T.source_type, t) for t in ("application/pdf", "image/webp", "x")] == ["pdf", "image", "scan"]


def test_wall_records(spark):
    line = lambda *p: Row(x1=p[0], y1=p[1], x2=p[2], y2=p[3])
    flat = one(spark, G.wall_record(F.col("a"), F.col("b"), F.lit(15.04), F.lit(True), F.lit("p")), a=line(0, 10, 100, 11), b=line(5, 25, 120, 25))
    assert flat["geometry"] == [[0, 17], [120, 17]] and flat["polygon_px"] == [[0, 10], [120, 10], [120, 25], [0, 25]]
    assert (flat["wall_type"], flat["length_px"], flat["thickness_px"]) == ("exterior", 120.0, 15.0)
    tall = one(spark, G.wall_record(F.col("a"), F.col("b"), F.lit(6), F.lit(False), F.lit("p")), a=line(10, 0, 10, 90), b=line(16, 5, 17, 100))
    assert tall["geometry"] == [[13, 0], [13, 100]] and tall["wall_type"] == "interior" and tall["id"] == flat["id"]


def test_gaps_close_at_the_next_sample_or_the_end(spark):
    ink = [80, 10, 10, 80, 80, 80, 10, 10, 10, 80, 20]
    rows = spark.createDataFrame([(1, i / 10, float(v), 300.0) for i, v in enumerate(ink)], "wall int, t double, ink double, length double")
    got = [(r.opens_at, round(r.closes_at, 6), round(r.width_px, 6)) for r in wall_gaps(rows, "wall", "t", "ink", "length").orderBy("opens_at").collect()]
    assert got == [(0.1, 0.3, 60.0), (0.6, 0.9, 90.0)]  # the last one would be 0 wide
    rows = spark.createDataFrame([(1, i / 9, float(v), 300.0) for i, v in enumerate(ink[:8] + [10, 10])], "wall int, t double, ink double, length double")
    assert [round(r.width_px, 3) for r in wall_gaps(rows, "wall", "t", "ink", "length").orderBy("opens_at").collect()] == [66.667, 100.0]


def test_rooms_and_walls_by_id(spark):
    openings = spark.createDataFrame([(1, "w1"), (1, "w9")], "plan_id int, wall_id string")
    walls = spark.createDataFrame([(1, "w1", 1, 4.0), (1, "w1", 0, 6.0)], "plan_id int, wall_id string, position int, thickness_px double")
    assert {r.wall_id: r.thickness_px for r in on_walls(openings, walls).collect()} == {"w1": 6.0, "w9": 10.0}
    edges = spark.createDataFrame([(1, 10, 3), (1, 10, 9), (2, 10, 2)], "room int, samples int, hits int")
    assert {r.room: r.is_open for r in boundary_open(edges, ["room"]).collect()} == {1: False, 2: True}
    boxes = spark.createDataFrame([(1, 500, 10, 60), (2, 500, 30, 60), (3, 199, 1, 60), (4, 20000, 81, 300)], "id int, area int, w int, h int")
    assert [r.id for r in contour_walls(boxes).collect()] == [1]


def test_settings_and_appends(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"floor_height": 2.7,\n "materials": {"door": {"name": "oak", "color_hex": "#8B7355"}, "roof": {"name": "slate", "color_hex": "#64605A", "opacity": 0.5}}}')
    read = blobs.settings(spark, str(tmp_path / "s.json")).first()
    assert read.floor_height == 2.7 and read.slab_thickness == 0.25 and blobs.settings(spark).first().floor_height == 3.0
    assert sorted(map(tuple, blobs.material_settings(spark, str(tmp_path / "s.json")).collect())) == [("door", "oak", "#8B7355", 1.0), ("roof", "slate", "#64605A", 0.5)]
    webp = [b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0\x1f\x03\0\x57\x02\0", b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a\x20\x03\x58\x02", b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (799 | 599 << 14).to_bytes(4, "little")]
    sizes = spark.createDataFrame([(w,) for w in webp], "content binary").select(blobs.jpeg_size(F.col("content")).alias("s")).collect()
    assert [tuple(r.s) for r in sizes] == [(800, 600)] * 3
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x02\x58\x03\x20" + b"\0" * 12
    got = spark.createDataFrame([(jpeg,), (b"no",), (None,)], "content binary").select(blobs.jpeg_size(F.col("content")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in got] == [(800, 600), None, None]


def test_last_material_wins(spark):
    rules = spark.createDataFrame([(1, 0, "walls", "brick", "#111111", None), (1, 1, "walls", None, None, "gloss"), (1, 2, None, "x", None, None)], "plan int, at int, target_surface string, material string, color_hex string, finish string")
    got = last_materials(rules, ["plan"], "at").first().materials
    assert {k: tuple(v) for k, v in got.items()} == {"walls": ("concrete", "#CCCCCC", "gloss"), "wall": ("x", "#CCCCCC", "matte")}


def test_small_plans_and_joins_give_the_same_faces(spark):
    rng, rows = random.Random(5), []
    for plan in [None, *range(1, 12)]:
        for _ in range(rng.randint(4, 60)):
            x, y = rng.randrange(6), rng.randrange(6)
            rows.append((plan, x * 10, y * 10, *rng.choice([(x * 10 + 10, y * 10), (x * 10, y * 10 + 10)])))
        rows += [(plan, 100, 0, 200, 0), (plan, 200, 0, 200, 100), (plan, 200, 100, 100, 100), (plan, 100, 100, 100, 0)]
        # one that touches the square's corner from inside, one within that, and one on its own
        for x, y, n in ((100, 0, 40), (110, 10, 10), (160, 60, 20)):
            rows += [(plan, x, y, x + n, y + 1), (plan, x + n, y + 1, x + n, y + n), (plan, x + n, y + n, x + 1, y + n), (plan, x + 1, y + n, x, y)]
    df = spark.createDataFrame(rows, SEGMENTS).repartition(3)
    turned = lambda ring: min(tuple(ring[i:] + ring[:i]) for i in range(len(ring)))
    seen = [sorted(((r.plan or 0, tuple(r.first), r.area, turned([tuple(p) for p in r.ring])) for r in faces(df, small).collect())) for small in (0, 40, 10_000)]
    assert len(seen[0]) > 40 and seen[0] == seen[1] == seen[2]


def test_a_ring_stands_once_in_the_solid_drawn_from_it(spark):
    ring = F.transform(F.sequence(F.lit(0), F.col("n").cast("int")), lambda i: F.struct(i.alias("x"), (i * i).alias("y")))
    plan = spark.range(1).select(F.col("id").alias("n")).select(G.extruded(ring, F.lit(0.0), F.lit(1.0)).alias("m"))
    assert plan._jdf.queryExecution().analyzed().toString().count("sequence(0, cast(n#") == 1


@pytest.mark.parametrize("corners", [True, False])
def test_small_plans_and_joins_give_the_same_regions(spark, corners):
    rng = random.Random(8)
    walls = spark.createDataFrame([(p, rng.randrange(30), rng.randrange(12)) for p in range(6) for _ in range(60 + 25 * p)], "plan int, x int, y int")
    frames = spark.createDataFrame([(p, 30, 12) for p in range(6)], "plan int, width int, height int")
    seen = [sorted(map(tuple, free_rooms(walls, frames, 1, 1.0, corners, small).collect())) for small in (0, 90, 10_000)]
    assert len(seen[0]) > 5 and seen[0] == seen[1] == seen[2]
