"""Pixels per metre from texts, matched rooms and bounding boxes; rule folding and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scale_from_area(square_feet: Column, width: Column, height: Column) -> Column:
    """The floor is taken to cover 70 % of the drawing's box."""
    return F.sqrt(F.try_divide(0.7 * width * height, square_feet * 0.0929))


def fallback_scale(area_px: Column, side: Column) -> Column:
    """min(side / 20, sqrt(area / 20)): a building 20 m long or of 20 square metres, whichever gives less."""
    return F.when(area_px < 1, side / 20).otherwise(F.least(side / 20, F.sqrt(area_px / 20)))


def scale_from_rooms(rooms_area: Column, width: Column, height: Column, square_meters: Column) -> Column:
    """struct<px_per_meter, confidence>: from the drawn area of all rooms, or 60 % of the box where that is below 100.

    The real area is ``square_meters`` if known, else that of a building whose longer side is 15 metres, 20 square
    metres at least. Without any drawn area it is 50 pixels at a confidence of 0.1.
    """
    drawn = F.when(F.coalesce(rooms_area, F.lit(0)) < 100, width * height * 0.6).otherwise(rooms_area)
    guessed = F.greatest(F.coalesce(drawn * F.pow(F.try_divide(F.lit(15.0), F.greatest(width, height)), 2), F.lit(20.0)), F.lit(20.0))
    real = F.coalesce(F.nullif(square_meters, F.lit(0.0)), guessed)
    found = F.struct(F.sqrt(drawn / real).alias("px_per_meter"), F.lit(0.35).alias("confidence"))
    return F.when((drawn > 0) & (real > 0), found).otherwise(F.struct(F.lit(50.0).alias("px_per_meter"), F.lit(0.1).alias("confidence")))


def chosen_scale(text_scale: Column, text_confidence: Column, other_scale: Column, other_confidence: Column) -> Column:
    """struct<px_per_meter, confidence>: the text's from 0.4 on, else the more confident."""
    text = F.struct(text_scale.alias("px_per_meter"), text_confidence.alias("confidence"))
    other = F.struct(other_scale.alias("px_per_meter"), other_confidence.alias("confidence"))
    return F.when((text_confidence >= 0.4) | (text_confidence >= other_confidence), text).otherwise(other)


def rank_matched_scale(drawn: DataFrame, real: DataFrame, keys: list[str], drawn_area: str, real_area: str, tie: tuple[str, str]) -> DataFrame:
    """The median of sqrt(drawn / real) over rooms matched by their rank in area; unmatched rooms are left out."""
    rank = lambda c, t: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(c), t))
    a = drawn.select(*keys, F.col(drawn_area).alias("__a"), rank(drawn_area, tie[0]).alias("__rank"))
    b = real.select(*keys, F.col(real_area).alias("__b"), rank(real_area, tie[1]).alias("__rank"))
    matched = a.join(b, [*keys, "__rank"])
    return matched.groupBy(*keys).agg(F.median(F.sqrt(F.col("__a") / F.col("__b"))).alias("px_per_meter"), F.least(F.lit(0.8), 0.5 + 0.1 * F.count("*")).alias("confidence"))


def last_value(kind: Column, value: Column, order: Column, name: str, default: Column, keep_previous: bool) -> Column:
    """The value of the last rule of a kind; a rule without one keeps the previous or resets to the default."""
    chosen = (kind == name) & (value.isNotNull() if keep_previous else F.lit(True))
    return F.coalesce(F.max_by(F.when(chosen, value), F.when(chosen, order)), default)


def last_materials(rules: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and ``materials``, map<surface, struct<name, color_hex, finish>>: of each surface's rules the last, missing
    fields filled; a surface's rules meet in a map-side combined maximum, so no key's rules are gathered."""
    surface = F.coalesce("target_surface", F.lit("wall")).alias("surface")
    filled = F.struct(F.coalesce("material", F.lit("concrete")).alias("name"), F.coalesce("color_hex", F.lit("#CCCCCC")).alias("color_hex"), F.coalesce("finish", F.lit("matte")).alias("finish"))
    last = rules.select(*keys, surface, F.col(order).alias("__order"), filled.alias("m")).groupBy(*keys, "surface").agg(F.max_by("m", "__order").alias("m"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("surface", "m"))).alias("materials"))


def plan_flags(white_ratio: Column, confidence: Column, open_rooms: Column, walls: Column, rooms: Column) -> Column:
    """What is doubtful about a plan, in the order in which it is found out."""
    return F.array_compact(
        F.array(
            F.when(white_ratio > 0.95, "very_sparse_content"),
            F.when(white_ratio < 0.5, "very_dense_content"),
            F.when(confidence < 0.5, "scale_uncertain"),
            F.when(open_rooms > 0, F.concat(open_rooms.cast("string"), F.lit("_rooms_have_open_boundaries"))),
            F.when(walls < 3, "very_few_walls"),
            F.when(rooms < 1, "no_rooms_detected"),
        )
    )


def overall_confidence(mean: Column, walls: Column, rooms: Column) -> Column:
    few = F.when(walls < 3, 0.7).otherwise(1.0) * F.when(rooms < 1, 0.5).otherwise(1.0)
    return F.round(F.least(mean * few, F.lit(1.0)), 2)
