"""What the outside sees of plans and models: nested records without their inner fields, first keys and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def picked(record: Column, *fields: str) -> Column:
    return F.struct(*[record[f].alias(f) for f in fields])


def stripped_wall(w: Column) -> Column:
    return F.struct(w["name"].alias("id"), *[w[f].alias(f) for f in ("geometry", "thickness_px", "wall_type", "confidence", "observation_type")])


def stripped_room(r: Column) -> Column:
    return F.struct(r["name"].alias("id"), *[r[f].alias(f) for f in ("label", "geometry", "area_px", "confidence", "observation_type")])


def stripped_opening(o: Column) -> Column:
    """An opening without a type is a door."""
    kind = F.coalesce(o["opening_type"], F.lit("door")).alias("opening_type")
    return F.struct(o["name"].alias("id"), o["wall_id"].alias("wall_id"), kind, *[o[f].alias(f) for f in ("geometry", "position_on_wall", "width_px", "confidence", "observation_type")])


def room_summary(r: Column, label: str | None = "label", confidence: str | None = "confidence") -> Column:
    """Id, label and confidence; defaults stand for fields that records of this kind lack, not for null values."""
    return F.struct(r["name"].alias("id"), (r[label] if label else F.lit("Unknown")).alias("label"), (r[confidence] if confidence else F.lit(0.0)).alias("confidence"))


def glb_key(geometry_layer: Column) -> Column:
    """The storage key of the first mesh, null where there is none."""
    return F.try_element_at(geometry_layer["meshes"], F.lit(1))["storage_key"]


def percent(share: Column) -> Column:
    """Whole percents, halves rounded up."""
    return F.floor(share * 100 + 0.5)
