"""Binary files and settings as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The defaults that rules are folded over.
DEFAULTS = {
    "floor_height": 3.0,
    "slab_thickness": 0.25,
    "wall_thickness_exterior": 0.3,
    "wall_thickness_interior": 0.15,
    "window_sill_height": 0.9,
    "window_default_height": 1.2,
    "door_default_height": 2.1,
    "door_default_width": 0.9,
    "roof_parapet_height": 0.2,
}
MATERIALS = {
    "wall_exterior": "#E5E1D8",
    "wall_interior": "#F5F2EE",
    "floor": "#8C827A",
    "ceiling": "#FAFAFA",
    "roof": "#64605A",
    "window_glass": "#A0D2F0",
    "door": "#8B7355",
}


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def settings(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row of numeric defaults: those of a JSON file, the fixed ones where it lacks a name or there is no file."""
    fixed = [F.lit(v).alias(k) for k, v in DEFAULTS.items()]
    if path is None:
        return spark.range(1).select(*fixed)
    read = spark.read.option("multiLine", "true").schema(", ".join(f"{k} double" for k in DEFAULTS)).json(path)
    return read.select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in DEFAULTS.items()])


def material_settings(spark: SparkSession, path: str) -> DataFrame:
    """(surface, name, color_hex, opacity): the materials of a JSON file of settings."""
    one = "struct<name:string,color_hex:string,opacity:double>"
    read = spark.read.option("multiLine", "true").schema(f"materials map<string,{one}>").json(path)
    return read.select(F.explode("materials").alias("surface", "m")).select("surface", "m.name", "m.color_hex", F.coalesce("m.opacity", F.lit(1.0)).alias("opacity"))


def _jpeg_size(content: bytes) -> tuple[int, int] | None:
    """Walks from segment to segment up to the one that holds the size."""
    at = 2
    while at + 9 <= len(content) and content[at] == 0xFF:
        kind, length = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + length
    return None


def _webp_size(content: bytes) -> tuple[int, int] | None:
    """The size in the header of a lossy, lossless or extended file."""
    kind, number = content[12:16], lambda i, n: int.from_bytes(content[i : i + n], "little")
    if kind == b"VP8 " and content[23:26] == b"\x9d\x01\x2a":
        return number(26, 2) & 0x3FFF, number(28, 2) & 0x3FFF
    if kind == b"VP8L" and content[20:21] == b"\x2f":
        bits = number(21, 4)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return (number(24, 3) + 1, number(27, 3) + 1) if kind == b"VP8X" and len(content) >= 30 else None


def _size(content: bytes | None) -> tuple[int, int] | None:
    if content is None:
        return None
    if content[:2] == b"\xff\xd8":
        return _jpeg_size(content)
    return _webp_size(content) if content[:4] == b"RIFF" and content[8:12] == b"WEBP" else None


def jpeg_size(content: Column) -> Column:
    """struct<width, height> read from a JPEG's segments or a WebP file's header, null for anything else."""

    @F.arrow_udf("struct<width:int,height:int>")
    def sizes(contents: pa.Array) -> pa.Array:
        found = [_size(c) for c in contents.to_pylist()]
        return pa.array([s and {"width": s[0], "height": s[1]} for s in found], pa.struct([("width", pa.int32()), ("height", pa.int32())]))

    return sizes(content)


def image_size(content: Column) -> Column:
    """struct<width, height> read from a PNG's header, null for anything else; ``jpeg_size`` reads JPEG files."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def materials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(MATERIALS.items()), "surface string, color_hex string")
