"""Nested values as canonical JSON text, and fingerprints of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, MapType, StringType, StructType


def quoted(text: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes and control characters escaped, other signs as \\\\uXXXX, in two halves beyond 16 bits."""
    plain = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        hexed = lambda v: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(v)), 4, "0"))
        high, low = F.shiftright(code - 0x10000, 10) + 0xD800, (code - 0x10000) % 1024 + 0xDC00
        return F.when(code < 128, c).when(code < 0x10000, hexed(code)).otherwise(F.concat(hexed(high), hexed(low)))

    return F.when(F.length(plain) == F.octet_length(plain), plain).otherwise(F.array_join(F.transform(F.split(plain, ""), escaped), ""))


def number(value: Column) -> Column:
    """A double in its shortest digits, whole ones below 10^16 written out with one decimal place."""
    whole = (F.abs(value) < 1e16) & (value == F.floor(value))
    return F.when(whole, F.concat(value.cast("bigint").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))


def canonical_json(value: Column, kind: DataType) -> Column:
    """JSON text of a value of any nested type that does not depend on the order of its fields: names sorted, a space after
    commas and colons, nulls kept as null, so values that differ in one field differ in their text.

    Map entries are sorted by key; a map with a null value keeps it.
    """
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(": "), canonical_json(value.getField(f.name), f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: canonical_json(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(value))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(": "), canonical_json(e["value"], kind.valueType))), ", "), F.lit("}"))
    elif isinstance(kind, StringType):
        text = quoted(value)
    elif isinstance(kind, (DoubleType, FloatType)):
        text = number(value.cast("double"))
    elif isinstance(kind, BooleanType):
        text = value.cast("string")
    else:
        text = F.when(value.isNotNull(), value.cast("string"))
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def fingerprint(value: Column, kind: DataType) -> Column:
    """SHA-256 of the canonical text, in lower-case hexadecimal digits."""
    return F.sha2(canonical_json(value, kind), 256)
