"""Sharding by sampled splitters; the law that holds is `bytes`: sizes near equal.

Rows are ordered by (hash of the text, doc_id, row number). Splitters come from a size-weighted sample of these keys:
row r gets the priority -ln(u)/size with u from a hash, and the smallest priorities are an exact weighted sample
without replacement. Quantiles of the sample cut the order into fine ranges. Exact byte totals of the ranges are
counted; ranges that hold more than twice their share are subdivided by samples of their own, all in one pass, until no range is
overfull or each overfull one has been cut at all of its rows. Within its range each row knows its exact place among all rows, and the shard is the
one in which the middle of its bytes falls, so a shard differs from the mean by less than the largest row's size.
Equal texts are neighbours in this order: a group of copies lies in one shard unless a boundary has to cut it.

What reaches the driver: the sample (`sample_per_range` keys for each fine range of a round) and the totals of the
fine ranges, both bounded by the number of shards.

Defined cases: null text has size 16; null doc_id sorts first; equal rows are told apart by their row number in the
staged table; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom.llm.common import Staged, table, text_or_empty, width

OVERHEAD = 16
KEY = ["h", "id_null", "id", "rid"]


def find_range(frame, splitters):
    """Index of the range of each key: splitters at or below it. Keys compare field by field."""
    if not len(splitters):
        return np.zeros(len(frame["h"]), np.int32)
    kind = [("h", "<i8"), ("id_null", "<i8"), ("id", "<i8"), ("rid", "<i8")]
    cuts = np.array([tuple(s) for s in splitters], kind)
    first = cuts["h"]
    low, high = np.searchsorted(first, frame["h"], "left"), np.searchsorted(first, frame["h"], "right")
    out = low.astype(np.int32)
    rest = [np.asarray(frame[k]) for k in KEY[1:]]
    tied = np.flatnonzero(low != high)  # keys whose hash is that of a splitter
    for h in np.unique(np.asarray(frame["h"])[tied]):
        own = tied[np.asarray(frame["h"])[tied] == h]
        among = cuts[first == h]
        both = [np.concatenate([among[k], r[own]]) for k, r in zip(KEY[1:], rest)]
        is_key = np.arange(len(both[0])) >= len(among)
        order = np.lexsort((is_key, *both[::-1]))  # a splitter comes before a key that equals it
        passed = np.cumsum(~is_key[order])
        out[own[order[is_key[order]] - len(among)]] += passed[is_key[order]].astype(np.int32)
    return out


def with_range(keys: DataFrame, splitters: list) -> DataFrame:
    def run(batches):
        for b in batches:
            frame = {k: b.column(k).to_numpy(zero_copy_only=False) for k in KEY}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(find_range(frame, splitters), pa.int32())], names=[*b.schema.names, "range"])

    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField("range", T.IntegerType())]))


def priority():
    u = (F.xxhash64("h", "id", "rid", F.lit(7)).bitwiseAND(F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    return -F.log(u) / F.col("size")


def weighted_sample(keys: DataFrame, n: int) -> list:
    rows = keys.select(*KEY, priority().alias("p")).orderBy("p", *KEY).limit(n).collect()
    return sorted(tuple(r[k] for k in KEY) for r in rows)


def quantiles(sample: list, parts: int) -> list:
    cuts = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    return sorted(set(cuts))


def shard(docs: DataFrame, n_shards: int = 40, ranges_per_shard: int = 4, sample_per_range: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    spark = docs.sparkSession
    staged = Staged(spark, "shard")
    text = text_or_empty()
    slim = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    slim = slim.select("*", F.when(F.col("doc_id").isNull(), 0).otherwise(1).cast("long").alias("id_null"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.monotonically_increasing_id().alias("rid"))
    keys = staged.write(slim, "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    n_ranges = n_shards * ranges_per_shard
    splitters = quantiles(weighted_sample(keys, n_ranges * sample_per_range), n_ranges)
    for round_ in count():
        ranged = with_range(keys, splitters)
        totals = {r["range"]: (r["bytes"], r["rows"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        over = {k: math.ceil(b * n_ranges / total) + 1 for k, (b, rows) in totals.items() if b > 2 * total / n_ranges and rows > 1}
        if not over:
            break
        # all overfull ranges in one pass: rows below a priority, about sample_per_range for each part wanted, more in later rounds
        most = F.create_map(*[x for k, parts in over.items() for x in (F.lit(k).cast("int"), F.lit(parts * sample_per_range * 2.0**round_ / totals[k][0]))])
        some: dict[int, list] = {}
        for r in ranged.where(priority() < F.try_element_at(most, F.col("range"))).select("range", *KEY).collect():
            some.setdefault(r["range"], []).append(tuple(r[k] for k in KEY))
        new = sorted({*splitters, *(c for k, v in some.items() for c in quantiles(sorted(v), over[k]))})
        if new == splitters and all(len(some.get(k, ())) >= totals[k][1] for k in over):
            break  # what is left are rows that are larger than a range
        splitters = new
    start, at = {}, [0, 0]
    for k in sorted(totals):
        start[k] = tuple(at)
        at = [at[0] + totals[k][0], at[1] + totals[k][1]]

    def place(batches):
        """Rows come range by range, in order; a range's running sums carry over from batch to batch."""
        now, cum, seen = None, 0, 0
        for b in batches:
            rng, size = b.column("range").to_numpy(), b.column("size").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(rng)) + 1).tolist(), len(rng)] if len(rng) else [0]
            mid, row = np.empty(len(rng)), np.empty(len(rng), np.int64)
            for i, j in zip(edges, edges[1:]):
                if now != rng[i]:
                    now, (cum, seen) = rng[i], start[int(rng[i])]
                ends = cum + np.cumsum(size[i:j])
                mid[i:j], row[i:j] = ends - size[i:j] / 2, seen + np.arange(j - i)
                cum, seen = int(ends[-1]), seen + j - i
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(np.minimum(mid * n_shards // max(total, 1), n_shards - 1).astype(np.int32)), pa.array(row)], names=["doc_id", "size", "text_crc32", "shard", "row"])

    ordered = ranged.repartition(width(spark, len(totals), 64), "range").sortWithinPartitions("range", *KEY)
    placed = staged.write(ordered.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, row long"), "placed")
    staged.drop("keys")
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("row").alias("first")).collect()}

    slot = F.col("row") - F.get(F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(n_shards)]), F.col("shard"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_shard(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
