"""Profiles over unbounded input: the same statistics kept up by a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_profile(events: DataFrame, time: str, value: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, range and mean of a value for each window and key; rows later than the watermark are left out. Works on batch
    and on streaming input alike."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), F.col(by))
        .agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"))
        .select(F.col("w.start").alias("start"), F.col(by), "n", "low", "high", "mean")
    )


def encode_stream(source: DataFrame, encode, path: str, checkpoint: str):
    """Encode each micro-batch of (stream_id, chunk_id, pos, value) rows and append it as Parquet; a chunk must arrive whole."""
    return source.writeStream.foreachBatch(lambda batch, i: encode(batch).withColumn("batch", F.lit(i)).write.mode("append").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
