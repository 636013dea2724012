"""Stored blobs: compressed blocks with their places, so that a range of bytes is read without the rest; joins and lists of blobs.

A store is a table (id, chunk_id, start, size, stored): written as Parquet, a range's filter on start and size reaches the scan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.functions import codecs
from streamloom.sources.streams import blocks, spread


def bound(size):
    """The most bytes that a compressed block of so many bytes takes: a column or a number."""
    return size + (F.floor(size / 8) if not isinstance(size, int) else size // 8) + 1024


def pack(blobs: DataFrame, codec: str = "zstd", level: int = 3, size: int = 1 << 20, max_input: int | None = None) -> DataFrame:
    """Blobs (id, bytes) as a store. Blocks are of `size` bytes, or of `max_input` where the codec takes no more. A null blob is empty."""
    step = min(size, max_input or size)
    rows = blobs.select(F.col("id").cast("long"), F.coalesce("bytes", F.lit(b"")).alias("bytes"))
    cut = blocks(rows, "id", "bytes", step)
    cut = cut.select("id", "chunk_id", (F.col("chunk_id") * step).alias("start"), F.octet_length("bytes").cast("long").alias("size"), "bytes")

    def run(batches):
        there = codecs.bindings()[codec][0]
        for b in batches:
            made = pa.array([there(x, level) if x else b"" for x in b.column("bytes").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "chunk_id", "start", "size")), made], names=["id", "chunk_id", "start", "size", "stored"])

    return spread(cut, "id", "chunk_id").mapInArrow(run, "id long, chunk_id long, start long, size long, stored binary")


def read(store: DataFrame, codec: str = "zstd", start: int = 0, length: int | None = None) -> DataFrame:
    """id, bytes [start, start + length) of each blob; only blocks that the range meets are decompressed. A range past a blob's end is
    empty; no row is lost."""
    wanted = F.col("start") + F.col("size") > start
    if length is not None:
        wanted = wanted & (F.col("start") < start + length)

    def run(batches):
        back = codecs.bindings()[codec][1]
        for b in batches:
            out = []
            for at, n, x in zip(b.column("start").to_pylist(), b.column("size").to_pylist(), b.column("stored").to_pylist()):
                end = n if length is None else min(n, start + length - at)
                out.append(back(x, n)[max(start - at, 0) : max(end, 0)] if n else b"")
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("chunk_id"), pa.array(out, pa.binary())], names=["id", "chunk_id", "bytes"])

    parts = store.where(wanted).select("id", "chunk_id", "start", "size", "stored").mapInArrow(run, "id long, chunk_id long, bytes binary")
    # first blocks stand for blobs that the range does not meet
    every = store.where("chunk_id = 0").select("id", F.lit(-1).cast("long").alias("chunk_id"), F.lit(b"").alias("bytes"))
    ordered = F.sort_array(F.collect_list(F.struct("chunk_id", F.hex("bytes").alias("h"))))
    return parts.unionByName(every).groupBy("id").agg(F.unhex(F.array_join(F.transform(ordered, lambda p: p["h"]), "")).alias("bytes"))


def listed(store: DataFrame) -> DataFrame:
    """id, size, chunks of what is stored."""
    return store.groupBy("id").agg(F.sum("size").alias("size"), F.count("*").alias("chunks"))


def joined(blobs: DataFrame, step: int = 4096) -> DataFrame:
    """Where each blob begins when all are joined in the order of their ids: id, start, size. Running sums are taken within ranges of
    `step` ids, and over the totals of the ranges, so no task holds more than a range or the table of totals."""
    rows = blobs.select("id", F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long").alias("size"), F.expr(f"id div {step}").alias("part"))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    totals = rows.groupBy("part").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(totals, F.col("part") == F.col("p")).select("id", (F.col("before") + F.col("inside")).alias("start"), "size")
