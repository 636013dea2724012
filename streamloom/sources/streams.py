"""Typed streams: rows (stream_id, chunk_id, pos, value). Order within a stream is the column pos, never the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1024
#: element types of a stream, as bits of a mask
TYPES = {"serial": 1, "struct": 2, "numeric": 4, "string": 8}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(df: DataFrame, name: str, order: str, value: Column, chunk: int = CHUNK) -> DataFrame:
    """A column as a stream; a chunk holds the rows whose order key divides alike, so chunks are cut without a global sort."""
    rows = df.select(F.lit(name).alias("stream_id"), F.expr(f"{order} div {chunk}").cast("long").alias("chunk_id"), F.col(order).alias("__order"), value.alias("value"))
    at = F.row_number().over(Window.partitionBy("stream_id", "chunk_id").orderBy("__order")) - 1
    return rows.select("stream_id", "chunk_id", at.cast("long").alias("pos"), "value")


def price(spark, sf_dir) -> DataFrame:
    return stream(table(spark, sf_dir, "orders"), "price", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long"))


def order_day(spark, sf_dir) -> DataFrame:
    return stream(table(spark, sf_dir, "orders"), "day", "o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long"))


def user(spark, sf_dir) -> DataFrame:
    return stream(table(spark, sf_dir, "events"), "user", "event_id", F.col("user_id"))


def clicks(spark, sf_dir) -> DataFrame:
    """Mostly zero: the cents of an event's value where its id divides by five."""
    return stream(table(spark, sf_dir, "events"), "sparse", "event_id", F.when(F.col("event_id") % 5 == 0, F.round(F.col("value") * 100).cast("long")).otherwise(F.lit(0).cast("long")))


def event_type(spark, sf_dir) -> DataFrame:
    return stream(table(spark, sf_dir, "events"), "event_type", "event_id", F.col("event_type"))


def priority(spark, sf_dir) -> DataFrame:
    return stream(table(spark, sf_dir, "orders"), "priority", "o_orderkey", F.col("o_orderpriority"))


def part_names(spark, sf_dir) -> DataFrame:
    """Names of parts in sorted order within chunks of the part key."""
    rows = table(spark, sf_dir, "part").select(F.lit("p_name").alias("stream_id"), F.expr(f"p_partkey div {CHUNK}").cast("long").alias("chunk_id"), F.col("p_name").alias("value"), "p_partkey")
    at = F.row_number().over(Window.partitionBy("chunk_id").orderBy("value", "p_partkey")) - 1
    return rows.select("stream_id", "chunk_id", at.cast("long").alias("pos"), "value")


def text_bytes(spark, sf_dir) -> DataFrame:
    """The bytes of each event's properties as a serial stream; a chunk is an event."""
    hexed = F.hex(F.encode("props", "UTF-8"))
    rows = table(spark, sf_dir, "events").select(F.lit("props").alias("stream_id"), F.col("event_id").alias("chunk_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.octet_length("props") - 1), lambda i: F.conv(F.substr(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))).alias("pos", "value"))
    return rows.select("stream_id", "chunk_id", F.col("pos").cast("long"), "value")


def catalog_of(streams: DataFrame, kind: str, width: int) -> DataFrame:
    """stream_id, type, elt_width, chunks, elements."""
    return streams.groupBy("stream_id").agg(F.count_distinct("chunk_id").alias("chunks"), F.count("*").alias("elements")).select("stream_id", F.lit(kind).alias("type"), F.lit(width).alias("elt_width"), "chunks", "elements")


def files(spark: SparkSession, paths: list[str], recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """path, length, modificationTime, content of files; directories are expanded."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths)


def blocks(df: DataFrame, key: str, content: str, size: int = 16 << 20, align: int = 1) -> DataFrame:
    """Fixed cuts of binary values, aligned to the element width: key, chunk_id, bytes. The last one is the remainder."""
    size -= size % align
    cut = F.sequence(F.lit(0), F.greatest(F.octet_length(content) - 1, F.lit(0)), F.lit(size))
    rows = df.select(key, F.col(content), F.posexplode(cut).alias("chunk_id", "at"))
    return rows.select(key, F.col("chunk_id").cast("long"), F.expr(f"substring({content}, at + 1, {size})").alias("bytes"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores where a few files would leave most of them idle, for work that costs far more than moving the rows once."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, F.xxhash64(*keys)) if df.rdd.getNumPartitions() < cores else df
