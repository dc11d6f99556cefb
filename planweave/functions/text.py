"""Dimension texts, room types, file names and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a plan's texts look like and the units they are in.
FOOT_MARK = "['‘’\\-]?"
INCH_MARK = "[\"“”″]?"
LENGTH = rf"(\d+)\s*{FOOT_MARK}\s*(\d+)?\s*{INCH_MARK}"
ROOM_DIMENSION = rf"{LENGTH}\s*[xX×]\s*{LENGTH}"
SQUARE_FEET = r"(?i)SQ\s*FT\s*(\d+)|(\d+)\s*SQ\s*FT"
CEILING = rf"(?i)CEILING\s*HEIGHT\s*{LENGTH}"
STRICT_ROOM = "(?i)(\\d+)\\s*['‘’]\\s*(\\d+)\\s*[\"“”]?\\s*[x×]\\s*(\\d+)\\s*['‘’]\\s*(\\d+)\\s*[\"“”]?"
SQUARE_FEET_AFTER = r"(?i)SQ\s*FT\s*(\d+)"
SQUARE_FEET_BEFORE = r"(?i)(\d+)\s*SQ\s*FT"
STRICT_CEILING = "(?i)CEILING\\s*HEIGHT\\s*(\\d+)\\s*['‘’]\\s*(\\d+)\\s*[\"“”]?"
MARKED_NUMBER = "\\d+['\"]"
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp")
METERS_PER_INCH = 0.0254
SQUARE_METERS_PER_SQUARE_FOOT = 0.0929
ROOM_TYPES = (
    ("bedroom", ("bed",), ()),
    ("bathroom", ("bath",), ()),
    ("kitchenette", ("kitchenette",), ()),
    ("kitchen", ("kitchen",), ()),
    ("living_dining", (("living", "dining"),), ()),
    ("dining_room", ("dining",), ()),
    ("living_room", ("living",), ()),
    ("foyer", ("foyer", "entry"), ()),
    ("closet", ("closet",), ("cl",)),
    ("hwh", ("hwh", "water heater"), ()),
    ("wd", ("w/d", "washer"), ()),
    ("ref", ("refrigerator",), ("ref",)),
    ("dw", ("dw", "dishwasher"), ()),
)
GRAY = (200, 200, 200, 255)


def group(text: Column, pattern: str, n: int) -> Column:
    """A group of the first match as a number, null where the group or the match is missing."""
    return F.regexp_extract(text, pattern, n).try_cast("int")


def meters(feet: Column, inches: Column) -> Column:
    return (feet * 12 + F.coalesce(inches, F.lit(0))) * METERS_PER_INCH


def between(value: Column, low: float, high: float) -> Column:
    """The value, null unless it lies strictly between the bounds."""
    return F.when((value > low) & (value < high), value)


def room_dimension(text: Column) -> Column:
    """struct<width_m, height_m, area_m2> of the first room dimension of plausible size, else null."""
    width = meters(group(text, ROOM_DIMENSION, 1), group(text, ROOM_DIMENSION, 2))
    height = meters(group(text, ROOM_DIMENSION, 3), group(text, ROOM_DIMENSION, 4))
    plausible = between(width, 1.0, 25.0).isNotNull() & between(height, 1.0, 25.0).isNotNull()
    return F.when(plausible, F.struct(width.alias("width_m"), height.alias("height_m"), (width * height).alias("area_m2")))


def square_feet(text: Column) -> Column:
    found = F.coalesce(group(text, SQUARE_FEET, 1), group(text, SQUARE_FEET, 2))
    return between(found, 50, 50000)


def ceiling_height(text: Column) -> Column:
    return F.round(between(meters(group(text, CEILING, 1), group(text, CEILING, 2)), 2.0, 6.0), 2)


def all_groups(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<g1, g2, ...>> of all matches; a number that is too large is null."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(n)), lambda g: g.try_cast("int")) for n in range(1, groups + 1)]
    return F.arrays_zip(*[f.alias(f"g{n}") for n, f in enumerate(found, 1)])


def strict_rooms(text: Column) -> Column:
    """array<struct<width_m, height_m, area_m2>> of all room dimensions with feet and inches, between 1 and 20 metres."""
    sizes = F.transform(all_groups(text, STRICT_ROOM, 4), lambda g: F.struct(meters(g["g1"], g["g2"]).alias("w"), meters(g["g3"], g["g4"]).alias("h")))
    kept = F.filter(sizes, lambda s: (s["w"] > 1.0) & (s["w"] < 20.0) & (s["h"] > 1.0) & (s["h"] < 20.0))
    return F.transform(kept, lambda s: F.struct(s["w"].alias("width_m"), s["h"].alias("height_m"), (s["w"] * s["h"]).alias("area_m2")))


def last_square_feet(text: Column) -> Column:
    """Of all square feet in range, those after the sign before those in front of it, the last."""
    both = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (SQUARE_FEET_AFTER, SQUARE_FEET_BEFORE)])
    return F.try_element_at(F.filter(F.transform(both, lambda g: g.try_cast("int")), lambda v: (v > 50) & (v < 50000)), F.lit(-1))


def last_ceiling_height(text: Column) -> Column:
    heights = F.transform(all_groups(text, STRICT_CEILING, 2), lambda g: meters(g["g1"], g["g2"]))
    return F.round(F.try_element_at(F.filter(heights, lambda h: (h > 2.0) & (h < 6.0)), F.lit(-1)), 2)


def is_label(text: Column) -> Column:
    """Whether a line of text names a room, holds a dimension, or a number with a mark."""
    return (room_type(text) != "unknown") | room_dimension(text).isNotNull() | text.rlike(MARKED_NUMBER)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\t-\r\x1C-\x20\x85\xA0]+|[\t-\r\x1C-\x20\x85\xA0]+$", "")


def without_fences(text: Column) -> Column:
    """The text between lines of three backticks, where it begins with one; any other text stripped only."""
    body = F.regexp_replace(F.regexp_replace(stripped(text), r"^```[^\n]*\n?", ""), r"(^|\n)[ \t]*```[ \t]*$", "")
    return F.when(stripped(text).startswith("```"), body).otherwise(stripped(text))


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; "bin" where there is no dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("bin")


def source_type(mime: Column) -> Column:
    return F.when(mime == "application/pdf", "pdf").when(mime.isin(*IMAGE_TYPES), "image").otherwise("scan")


def short_id(prefix: str, *parts: Column) -> Column:
    """An id of six hex digits that depends on ``parts`` alone, so that reruns agree; it may repeat in a large table."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 6))


def room_type(text: Column) -> Column:
    """The first type of ROOM_TYPES with a part that the text holds, or that is the whole text."""
    t = F.lower(stripped(text))
    out = None
    for name, parts, whole in ROOM_TYPES:
        hit = F.lit(False)
        for part in parts:
            both = F.lit(True)
            for p in (part,) if isinstance(part, str) else part:
                both = both & F.contains(t, F.lit(p))
            hit = hit | both
        for w in whole:
            hit = hit | (t == w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def safe_name(name: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen stay, anything else becomes an underscore; 64 characters at most."""
    return F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_"), 1, 64)


def first_page_key(key: Column) -> Column:
    return F.concat(F.regexp_replace(key, r"\.[^.]*$", ""), F.lit("_page1.png"))


def rgba(hex_color: Column) -> Column:
    """[r, g, b, 255] of six hex digits with or without a hash sign, gray for anything else."""
    digits = F.regexp_replace(hex_color, "^#+", "")
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.array(part(1), part(3), part(5), F.lit(255))).otherwise(F.array(*map(F.lit, GRAY)))
