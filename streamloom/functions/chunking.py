"""Content-defined fragments: cuts depend on the bytes around them, so an insertion moves only its own fragments."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE = np.random.default_rng(9).integers(0, 1 << 32, 256, dtype=np.uint64)


def cuts(data: bytes, mean: int, window: int = 32) -> list[int]:
    """Ends of the fragments: where a hash of the last `window` bytes is a multiple of mean, within [mean / 16, 8 * mean]."""
    b = TABLE[np.frombuffer(data, np.uint8)]
    zero = np.zeros(1, np.uint64)
    sums = np.concatenate([zero, np.cumsum(b * (np.arange(len(b), dtype=np.uint64) + np.uint64(1)))])
    flat = np.concatenate([zero, np.cumsum(b)])
    if len(b) < window:
        return [len(data)] if data else []
    at = np.arange(window, len(b) + 1)
    h = (sums[at] - sums[at - window]) - (at - window).astype(np.uint64) * (flat[at] - flat[at - window])
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    good = at[h % np.uint64(mean) == 0].tolist()
    out, last, low, high = [], 0, max(mean // 16, 1), 8 * mean
    for g in [*good, len(data)]:
        while g - last > high:
            last += high
            out.append(last)
        if g - last >= low or (g == len(data) and g > last):
            out.append(g)
            last = g
    return out


def fragments(df: DataFrame, key: str, content: str, mean: int = 1024) -> DataFrame:
    """name, no, start, size, hash (SHA-1) of the fragments of each value."""
    rows = df.select(F.col(key).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))

    def run(batches):
        for b in batches:
            out = []
            for name, data in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                last = 0
                for i, end in enumerate(cuts(data or b"", mean)):
                    out.append((name, i, last, end - last, hashlib.sha1(data[last:end]).hexdigest()))
                    last = end
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["name", "no", "start", "size", "hash"])

    return rows.mapInArrow(run, "name string, no long, start long, size long, hash string")
