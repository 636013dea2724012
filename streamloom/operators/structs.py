"""Fixed-width structs: serial content cut into structs, structs as numbers, numbers as structs, structs cut into fields.

A struct stream has the columns stream_id, chunk_id, pos and value, a binary of the struct's width. Content is cut with one
row a struct, never a row a byte, in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["stream_id", "chunk_id"]


def from_serial(df: DataFrame, width: int) -> DataFrame:
    """Structs of `width` bytes of the binary column content; a length that does not divide is an error."""
    size = F.octet_length("content")
    checked = F.when(size % width == 0, F.expr(f"cast(octet_length(content) div {width} as int)")).otherwise(F.raise_error(F.lit("bytes are left over")).cast("int"))
    rows = df.where(size > 0).select(*KEY, "content", F.explode(F.sequence(F.lit(0), checked - 1)).alias("pos"))
    return rows.select(*KEY, F.col("pos").cast("long"), F.substr("content", F.col("pos") * width + 1, F.lit(width)).alias("value"))


def to_serial(df: DataFrame) -> DataFrame:
    """The structs of each chunk one after the other, as the binary column content."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return df.groupBy(*KEY).agg(rows.alias("rows")).select(*KEY, F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["value"])), "")).alias("content"))


def swapped(hexed: Column, width: int) -> Column:
    """Hexadecimal text with its `width` bytes in the other order."""
    return F.concat(*[F.substr(hexed, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(width))])


def to_numbers(df: DataFrame, width: int, big: bool = False) -> DataFrame:
    """Structs of up to 8 bytes as unsigned numbers (decimal(20,0) for 8 bytes, else long)."""
    hexed = F.hex("value")
    value = F.conv(hexed if big else swapped(hexed, width), 16, 10)
    return df.select(*KEY, "pos", value.cast("decimal(20,0)" if width == 8 else "long").alias("value"))


def from_numbers(df: DataFrame, width: int, big: bool = False) -> DataFrame:
    """The lowest `width` bytes of numbers as structs."""
    hexed = F.lpad(F.hex(F.col("value").cast("long").bitwiseAND(F.lit((1 << 8 * width) - 1 if width < 8 else -1))), 2 * width, "0")
    return df.select(*KEY, "pos", F.unhex(hexed if big else swapped(hexed, width)).alias("value"))


def split_fields(df: DataFrame, sizes: list[int]) -> DataFrame:
    """A stream for each field of a struct: field (its number) and value, the field's bytes."""
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    wrong = F.raise_error(F.lit("fields do not cover the struct")).cast("array<binary>")
    parts = F.when(F.octet_length("value") == sum(sizes), F.array(*[F.substr("value", F.lit(s + 1), F.lit(n)) for s, n in zip(starts, sizes)])).otherwise(wrong)
    return df.select(*KEY, "pos", F.posexplode(parts).alias("field", "value"))


def join_fields(df: DataFrame) -> DataFrame:
    """The inverse of split_fields."""
    rows = F.sort_array(F.collect_list(F.struct("field", "value")))
    return df.groupBy(*KEY, "pos").agg(rows.alias("rows")).select(*KEY, "pos", F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["value"])), "")).alias("value"))
