"""Queries over versioned catalogues of entries (name, version, hash, size, deleted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(inside: DataFrame, outside: DataFrame, by: tuple[str, ...] = ("hash", "size")) -> DataFrame:
    """name and mark: "=" the same, "#" different, "-" missing outside, "+" missing inside."""
    a = inside.select(F.col("name").alias("a_name"), F.struct(*by).alias("a"))
    b = outside.select(F.col("name").alias("b_name"), F.struct(*by).alias("b"))
    mark = F.when(F.col("b_name").isNull(), "-").when(F.col("a_name").isNull(), "+").when(F.col("a").eqNullSafe(F.col("b")), "=").otherwise("#")
    return a.join(b, F.col("a_name") == F.col("b_name"), "full_outer").select(F.coalesce("a_name", "b_name").alias("name"), mark.alias("mark"))


def changes(inside: DataFrame, outside: DataFrame) -> DataFrame:
    return compare(inside, outside).where("mark <> '='")


def as_of(history: DataFrame, version: int) -> DataFrame:
    """Updates up to a version; a negative one counts from the end."""
    if version >= 0:
        return history.where(F.col("version") <= version)
    last = history.agg(F.max("version").alias("__last"))
    return history.crossJoin(F.broadcast(last)).where(F.col("version") <= F.col("__last") + version).drop("__last")  # one row


def latest(history: DataFrame) -> DataFrame:
    """The newest version of each name; names whose newest version is a deletion are absent."""
    newest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("version")))
    return history.withColumn("__n", newest).where("__n = 1").drop("__n").where("NOT deleted")


def versions(history: DataFrame) -> DataFrame:
    return history.groupBy("version").agg(F.sum((~F.col("deleted")).cast("long")).alias("updates"), F.sum(F.col("deleted").cast("long")).alias("deletions"), F.sum("size").alias("bytes"))


def glob(pattern: str) -> str:
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "(/.*)?$"


def select(entries: DataFrame, only: list[str] = (), but: list[str] = ()) -> DataFrame:
    """Names that match a pattern of `only` (if any) and none of `but`; a folder's pattern covers what is in it."""
    out = entries
    if only:
        out = out.where(F.expr("false") | F.array_contains(F.array(*[F.col("name").rlike(glob(p)) for p in only]), True))
    for p in but:
        out = out.where(~F.col("name").rlike(glob(p)))
    return out


def rename(entries: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    name = F.col("name")
    out = name
    for old, new in reversed(prefixes):
        out = F.when(F.startswith(name, F.lit(old)), F.concat(F.lit(new), F.substring(name, len(old) + 1, 1 << 20))).otherwise(out)
    return entries.withColumn("name", out)


def largest(entries: DataFrame, n: int) -> DataFrame:
    """The n largest entries; mark "^" where an entry repeats the hash of the one before it."""
    top = entries.orderBy(F.desc("size"), "hash", "name").limit(n)
    same = F.lag("hash").over(Window.orderBy(F.desc("size"), "hash", "name")).eqNullSafe(F.col("hash"))
    return top.select("name", "size", "hash", F.when(same & F.col("hash").isNotNull(), "^").otherwise("").alias("mark"))  # n rows


def first_copies(fragments: DataFrame) -> DataFrame:
    """name, no, hash, size, pointer: where the same content was seen first (itself if new)."""
    first = fragments.groupBy(F.col("hash").alias("f_hash")).agg(F.min(F.struct("name", "no")).alias("first"))
    return fragments.join(first, F.col("hash") == F.col("f_hash")).select("name", "no", "hash", "size", F.col("first.name").alias("first_name"), F.col("first.no").alias("first_no"))


def verify(stored: DataFrame, restored: DataFrame) -> DataFrame:
    """Names whose content did not come back as it was."""
    back = restored.select("name", F.sha1(F.col("content").cast("binary")).alias("now"))
    return stored.join(back, "name", "left").where("now IS NULL OR now <> hash").select("name")
