"""From detected lines to parsed plans: walls, rooms, openings, scale, confidence and flags in one flow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.functions.geometry import overlap_ratio
from planweave.operators import drawings
from planweave.operators.intervals import dedupe_walls, greedy_pairs, merged_extents
from planweave.operators.plane import plan_by_plan, starts
from planweave.operators.rooms import GRID, LARGEST_SHARE, LEAST_AREA, LEAST_ROOMS, LEAST_SEGMENTS, LEAST_WALLS, opening_kind, planar_rooms, plausible, plausible_openings
from planweave.operators.scale import overall_confidence, plan_flags, scale_from_rooms
from planweave.sources.scratch import Round

#: Thickness of walls in pixels, overlap of their lines, shortest wall; gap and offset of pieces that are one wall.
LEAST_THICK, MOST_THICK, LEAST_OVERLAP, LEAST_LENGTH, TOUCHING = 3, 80, 0.3, 15, 10
#: How near and how far overlapping a contour is known already, and a wall is a double.
KNOWN_NEAR, KNOWN_OVERLAP, DOUBLE_NEAR, DOUBLE_OVERLAP = 15, 0.3, 25, 0.4
#: Confidences of walls from line pairs, walls from contours, and rooms.
FROM_PAIRS, FROM_CONTOURS, OF_ROOMS = 0.85, 0.7, 0.9
KEYS = ["plan", "horizontal"]
#: Most lines, contours, gaps and arcs of a plan that is parsed in one task, and how many are parsed together.
SMALL, TOGETHER = 1024, 1 << 17


def unknown_contours(contours: DataFrame, walls: DataFrame) -> DataFrame:
    """The contours that no wall of the same direction covers: nearer than KNOWN_NEAR, and overlapping by more than KNOWN_OVERLAP of the longer."""
    at = F.floor(F.col("pos") / KNOWN_NEAR).cast("long")
    other = walls.select(*[F.col(c).alias(f"{c}_b") for c in (*KEYS, "pos", "s", "e")], F.explode(F.array(at - 1, at, at + 1)).alias("__at_b"))
    same = (F.col("plan") == F.col("plan_b")) & (F.col("horizontal") == F.col("horizontal_b")) & (F.col("__at") == F.col("__at_b"))
    covered = (F.abs(F.col("pos") - F.col("pos_b")) < KNOWN_NEAR) & (overlap_ratio(F.col("s"), F.col("e"), F.col("s_b"), F.col("e_b")) > KNOWN_OVERLAP)
    return contours.withColumn("__at", at).join(other, same & covered, "left_anti").drop("__at")


def detected_walls(lines: DataFrame, contours: DataFrame) -> DataFrame:
    """(plan, horizontal, wall, pos, s, e, thick, confidence): the walls of parallel lines (plan, id, horizontal, pos, s, e; whole pixels, ids below 2^31) and of long
    thin contours (the same and thick) that add to them.

    Pairs become walls along their middle, as long as both lines; pieces that touch on one line are merged in the order in which they were found, contours last; what is
    too short goes, and of doubles the thicker stays. ``wall`` tells a plan's walls of one direction apart.
    """
    pairs = greedy_pairs(lines, KEYS, LEAST_THICK, MOST_THICK, LEAST_OVERLAP)
    ends = pairs.select(*KEYS, "a", "b", "apart", F.explode(F.array("a", "b")).alias("id")).join(lines.select(*KEYS, "id", "pos", "s", "e"), [*KEYS, "id"])
    walls = ends.groupBy(*KEYS, "a", "b", "apart").agg(F.min("pos").alias("first"), F.sum("pos").alias("twice"), F.min("s").alias("s"), F.max("e").alias("e"))
    # found in the order of the first line's position
    order = (F.col("first").cast("long") + (1 << 30)) * (1 << 31) + F.col("a")
    # written, as each of these tables is read more than once
    walls = walls.select(*KEYS, order.alias("id"), (F.col("twice") / 2).cast("int").alias("pos"), "s", "e", F.col("apart").alias("thick"), F.lit(FROM_PAIRS).alias("confidence"))
    paired = Round(walls)
    walls = paired.table
    more = unknown_contours(contours, walls).select(*KEYS, (F.col("id") + (1 << 62)).alias("id"), "pos", "s", "e", "thick", F.lit(FROM_CONTOURS).alias("confidence"))
    walls = walls.unionByName(more)
    merged = merged_extents(walls, KEYS, TOUCHING, TOUCHING).select(*KEYS, F.col("first").alias("id"), "pos", "s", "e").filter(F.col("e") - F.col("s") >= LEAST_LENGTH)
    joined = Round(merged.join(walls.select(*KEYS, "id", "thick", "confidence"), [*KEYS, "id"]))
    paired.drop()
    merged = joined.table
    kept = dedupe_walls(merged, KEYS, DOUBLE_NEAR, DOUBLE_OVERLAP).select(*KEYS, F.col("kept").alias("id"))
    found = Round(merged.join(kept, [*KEYS, "id"]).withColumnRenamed("id", "wall")).table
    joined.drop()
    return found


def parsed_plans(frames: DataFrame, lines: DataFrame, contours: DataFrame, gaps: DataFrame, arcs: DataFrame) -> DataFrame:
    """(plan, walls, rooms, doors, windows, room_area, px_per_meter, confidence, flags): a row for each plan of ``frames`` (plan, width, height,
    white, square_meters or null).

    Walls are found in lines and contours, rooms in the walls' graph; the rooms' area gives the scale, which decides
    which gaps (plan, gap_id, cx, cy, width_px) are openings; those near an arc (plan, cx, cy) are doors. Every step hands its table to the next; only
    numbers per plan meet in the end.
    """
    walls = detected_walls(lines, contours)
    across, flat = F.col("horizontal"), F.col
    placed = walls.select("plan", *[F.when(across, flat(h)).otherwise(flat(v)).alias(n) for n, h, v in (("x1", "s", "pos"), ("y1", "pos", "s"), ("x2", "e", "pos"), ("y2", "pos", "e"))])
    rooms = planar_rooms(placed.join(frames.select("plan", "width", "height"), "plan").withColumnRenamed("plan", "plan_id"))
    of_walls = walls.groupBy("plan").agg(F.count("*").alias("walls"), F.sum("confidence").alias("wall_sum"))
    of_rooms = rooms.groupBy(F.col("plan_id").alias("plan")).agg(F.count("*").alias("rooms"), F.sum("area").alias("room_area"))
    plans = frames.join(of_walls, "plan", "left").join(of_rooms, "plan", "left").fillna(0, ["walls", "wall_sum", "rooms", "room_area"])
    scale = scale_from_rooms(F.col("room_area"), F.col("width"), F.col("height"), F.col("square_meters"))
    plans = Round(plans.withColumn("scale", scale).select("plan", "walls", "rooms", "wall_sum", "room_area", "white", "scale.px_per_meter", F.col("scale.confidence").alias("scale_confidence"))).table
    kinds = opening_kind(gaps.withColumnRenamed("plan", "plan_id"), arcs.withColumnRenamed("plan", "plan_id"))
    kinds = kinds.select(F.col("plan_id").alias("plan"), "gap_id", "kind").join(gaps.select("plan", "gap_id", "width_px"), ["plan", "gap_id"]).join(plans.select("plan", "px_per_meter"), "plan")
    openings = plausible_openings(kinds, F.col("px_per_meter")).groupBy("plan").agg(F.count_if(F.col("kind") == "door").alias("doors"), F.count_if(F.col("kind") == "window").alias("windows"))
    return flagged(plans.join(openings, "plan", "left").fillna(0, ["doors", "windows"]))


def flagged(plans: DataFrame) -> DataFrame:
    """The plans' numbers with the confidence and the flags that follow from them."""
    mean = (F.col("wall_sum") + OF_ROOMS * F.col("rooms")) / F.greatest(F.col("walls") + F.col("rooms"), F.lit(1))
    flags = plan_flags(F.col("white"), F.col("scale_confidence"), F.lit(0), F.col("walls"), F.col("rooms"))
    return plans.select("plan", "walls", "rooms", "doors", "windows", "room_area", "px_per_meter", overall_confidence(mean, F.col("walls"), F.col("rooms")).alias("confidence"), flags.alias("flags"))


LISTS = {"lines": ["id", "horizontal", "pos", "s", "e"], "contours": ["id", "horizontal", "pos", "s", "e", "thick"], "gaps": ["gap_id", "cx", "cy", "width_px"], "arcs": ["cx", "cy"]}
FRAME = ["width", "height", "white", "square_meters"]
PARSED = "walls bigint, rooms bigint, wall_sum double, room_area double, door_px array<bigint>, window_px array<bigint>, " + ", ".join(f"{c} double" for c in FRAME)
PARSED_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.float64()] * len(FRAME)]


def parsed_parts(parts: DataFrame, small: int | None = None) -> DataFrame:
    """``parsed_plans`` of plans that come in parts (plan, lines, contours, gaps, arcs: arrays of structs of whole numbers, and the plan's width, height, white and
    square_meters in each part).

    Plans of at most ``small`` (SMALL) lines, contours, gaps and arcs are parsed many at a time, in one pass over the parts once those of a plan
    are together; only larger ones go through the tables of ``parsed_plans``.
    """
    size = sum((F.coalesce(F.size(c), F.lit(0)) for c in LISTS), F.lit(1))
    double = [F.col(c).cast("double").alias(c) for c in FRAME]
    made, large = plan_by_plan(parts.select("plan", *LISTS, *double), small_plans, PARSED, PARSED_TYPES, SMALL if small is None else small, size, TOGETHER)
    scale = scale_from_rooms(F.col("room_area"), F.col("width"), F.col("height"), F.col("square_meters"))
    scaled = made.withColumn("scale", scale).withColumn("px_per_meter", F.col("scale.px_per_meter")).withColumn("scale_confidence", F.col("scale.confidence"))
    openings = lambda c: F.size(F.filter(c, lambda px: plausible(px, F.col("px_per_meter")))).cast("long")
    found = flagged(scaled.withColumn("doors", openings("door_px")).withColumn("windows", openings("window_px")))
    if large.isEmpty():
        return found
    frames = large.groupBy("plan").agg(*[F.max(c).alias(c) for c in FRAME])
    listed = {c: large.select("plan", F.explode(c).alias("__one")).select("plan", *[f"__one.{f}" for f in fields]) for c, fields in LISTS.items()}
    return found.unionByName(parsed_plans(frames, *listed.values()))


def small_plans(number: np.ndarray, part: pa.Table) -> tuple[np.ndarray, list[pa.Array]]:
    """The numbers of each plan: walls, rooms, their sums, the widths of gaps with an arc nearby and of others, and its frame."""
    n = int(number[-1]) + 1
    (plan, id_, flat, pos, s, e), (c_plan, c_id, c_flat, c_pos, c_s, c_e, c_thick), gaps, arcs = (drawings.parts_of(part, c, number, *fields) for c, fields in LISTS.items())
    # walls from pairs of lines, and from contours that none of them covers
    group = 2 * plan + flat
    a, b = drawings.paired(group, id_, pos, s, e, LEAST_THICK, MOST_THICK, LEAST_OVERLAP)
    w_group, w_pos, w_s, w_e = group[a], np.trunc((pos[a] + pos[b]) / 2).astype(np.int64), np.minimum(s[a], s[b]), np.maximum(e[a], e[b])
    c_group, new = 2 * c_plan + c_flat, np.ones(len(c_plan), bool)
    for i, j in drawings.met(c_group, c_pos - KNOWN_NEAR + 1, c_pos + KNOWN_NEAR - 1, w_group, w_pos):
        new[i[drawings.share(c_s[i], c_e[i], w_s[j], w_e[j]) > KNOWN_OVERLAP]] = False
    w_group, w_pos, w_s, w_e = (np.append(w, c[new]) for w, c in ((w_group, c_group), (w_pos, c_pos), (w_s, c_s), (w_e, c_e)))
    thick, contour = np.append(pos[b] - pos[a], c_thick[new]), np.repeat([0, 1], [len(a), new.sum()])
    order = [contour, np.append(np.minimum(pos[a], pos[b]), np.zeros(new.sum(), np.int64)), np.append(id_[a], c_id[new])]
    # pieces are merged and doubles left out, in the order in which they were found
    first, pos, s, e = drawings.merged(w_group, order, w_pos, w_s, w_e, TOUCHING, TOUCHING)
    long = e - s >= LEAST_LENGTH
    first, pos, s, e = (c[long] for c in (first, pos, s, e))
    stay = drawings.kept(w_group[first], [c[first] for c in order], pos, s, e, thick[first], DOUBLE_NEAR, DOUBLE_OVERLAP)
    first, pos, s, e = (c[stay] for c in (first, pos, s, e))
    plan, flat, contour = w_group[first] // 2, (w_group[first] % 2 == 1)[:, None], contour[first]
    walls, drawn = np.bincount(plan, minlength=n), np.bincount(plan, contour, minlength=n)
    # rooms
    ends = np.where(flat, np.column_stack([s, pos, e, pos]), np.column_stack([pos, s, pos, e]))
    of, area = drawings.room_areas(plan, ends, GRID, LEAST_WALLS, LEAST_SEGMENTS)
    head = part.take(pa.array(np.flatnonzero(starts(number))))
    width, height = (head[c].to_numpy() for c in ("width", "height"))
    with np.errstate(invalid="ignore"):
        fits = (area >= LEAST_AREA) & (area <= LARGEST_SHARE * width[of] * height[of])
    rooms, room_area = np.bincount(of[fits], minlength=n), np.bincount(of[fits], area[fits], minlength=n)
    enough = rooms >= LEAST_ROOMS
    rooms, room_area = np.where(enough, rooms, 0), np.where(enough, room_area, 0.0)
    # openings
    (g_plan, _, x, y, px), (r_plan, ax, ay) = gaps, arcs
    door, reach = np.zeros(len(px), bool), np.ceil(1.5 * np.maximum(px, 0)).astype(np.int64)
    for i, j in drawings.met(g_plan, x - reach, x + reach, r_plan, ax):
        door[i[np.sqrt((x[i] - ax[j]) ** 2 + (y[i] - ay[j]) ** 2) < 1.5 * px[i]]] = True
    openings = [drawings.lists_of(n, g_plan[some], px[some]) for some in (door, ~door)]
    sums = FROM_PAIRS * (walls - drawn) + FROM_CONTOURS * drawn
    return np.arange(n), [pa.array(walls), pa.array(rooms), pa.array(sums), pa.array(room_area), *openings, *(head[c].combine_chunks() for c in FRAME)]
