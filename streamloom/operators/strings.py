"""Transforms of string streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.operators.numeric import KEY, in_order, so_far

#: a whole number as it is written canonically
CANONICAL = "^(0|-?[1-9][0-9]*)$"


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix in bytes."""
    x, y = F.hex(a.cast("binary")), F.hex(b.cast("binary"))
    n = F.least(F.octet_length(a), F.octet_length(b))
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("same")),
        lambda s, i: F.when(s["same"] & (i <= n) & (F.substr(x, 2 * i - 1, F.lit(2)) == F.substr(y, 2 * i - 1, F.lit(2))), F.struct(i.alias("n"), F.lit(True).alias("same"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("same"))),
        lambda s: s["n"],
    )


def prefix(df: DataFrame) -> DataFrame:
    """Length of the prefix shared with the string before (in bytes), and the rest (as hexadecimal bytes and as text)."""
    rows = df.select(*KEY, "pos", "value", F.lag("value").over(in_order()).alias("before"))
    n = F.when(F.col("before").isNull(), 0).otherwise(shared_prefix(F.col("before"), F.col("value")))
    rows = rows.select(*KEY, "pos", "value", n.alias("shared"))
    return rows.select(*KEY, "pos", "shared", F.expr("substring(cast(value as binary), shared + 1, octet_length(value))").cast("string").alias("suffix"))


def undo_prefix(df: DataFrame) -> DataFrame:
    """Strings again: a running fold over the chunk."""
    rows = df.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "shared", "suffix"))).alias("rows"))
    binary = lambda x: x.cast("binary")
    fold = F.aggregate(
        "rows",
        F.struct(F.lit("").alias("last"), F.array().cast("array<struct<pos:bigint,value:string>>").alias("out")),
        lambda s, r: F.struct(
            F.concat(F.substring(binary(s["last"]), 1, r["shared"]), binary(r["suffix"])).cast("string").alias("last"),
            F.concat(s["out"], F.array(F.struct(r["pos"].alias("pos"), F.concat(F.substring(binary(s["last"]), 1, r["shared"]), binary(r["suffix"])).cast("string").alias("value")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return rows.select(*KEY, F.explode(fold).alias("r")).select(*KEY, "r.pos", "r.value")


def parse_int(df: DataFrame) -> DataFrame:
    """Canonical decimals as numbers; any other string is an error."""
    v = F.when(F.col("value").rlike(CANONICAL), F.expr("try_cast(value as bigint)"))
    return df.select(*KEY, "pos", F.coalesce(v, F.raise_error(F.lit("not a canonical number")).cast("long")).alias("value"))


def try_parse_int(df: DataFrame) -> DataFrame:
    """number where the string is a canonical decimal, exception where it is not, and the place in either output."""
    n = F.when(F.col("value").rlike(CANONICAL), F.expr("try_cast(value as bigint)"))
    rows = df.select(*KEY, "pos", "value", n.alias("number"))
    ok = F.col("number").isNotNull()
    at = F.when(ok, F.sum(ok.cast("long")).over(so_far())).otherwise(F.sum((~ok).cast("long")).over(so_far())) - 1
    return rows.select(*KEY, "pos", "number", F.when(~ok, F.col("value")).alias("exception"), at.alias("out_pos"))


def separate(df: DataFrame) -> DataFrame:
    """All content of a chunk as one string, and the lengths of its strings in bytes."""
    rows = df.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("rows"))
    return rows.select(*KEY, F.array_join(F.transform("rows", lambda r: r["value"]), "").alias("content"), F.transform("rows", lambda r: F.octet_length(r["value"])).alias("lengths"))


def set_lengths(df: DataFrame) -> DataFrame:
    """Strings again from content and lengths."""
    each = df.select(*KEY, "content", "lengths", F.posexplode("lengths").alias("pos", "n"))
    before = F.sum("n").over(Window.partitionBy(*KEY).orderBy("pos")) - F.col("n")
    rows = each.select(*KEY, "content", F.col("pos").cast("long"), "n", before.cast("int").alias("at"))
    return rows.select(*KEY, "pos", F.expr("cast(substring(cast(content as binary), at + 1, n) as string)").alias("value"))


def string_dispatch(df: DataFrame, index: Column) -> DataFrame:
    """Each string goes to the output of its index."""
    rows = df.select(*KEY, "pos", index.alias("output"), "value")
    at = F.row_number().over(Window.partitionBy(*KEY, "output").orderBy("pos")) - 1
    return rows.select(*KEY, "pos", "output", at.cast("long").alias("out_pos"), "value")
