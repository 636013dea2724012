"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations.

The documents of a source, in the order of a hash of doc_id, form a stream of bytes that is cut into blocks of
`block_bytes`; a document belongs to the block in which it begins. A source of weight w releases its block j (from 0)
at slot floor(j / w) with deadline ceil((j + 1) / w), and each slot goes to the released block of the earliest deadline
(ties: the order of the sources). So at every slot each source is less than one block away from its weight. Weights
are rounded to multiples of 1 / `period` (each at least one), whereby the schedule repeats after `period` slots: it is
computed once, with `period` rows at most, and block j of a source of weight c / period has slot
(j div c) * period + slot of (j mod c).

Blocks are whole in slots; documents are not cut, so in bytes a source may be ahead by its current document besides: one
longer than a block is emitted in the slot in which it begins, and the blocks that it runs through stay empty. More
than `period` sources are an error.

Nothing is dropped: the schedule runs until every document has been used once, and sources that end sooner begin
again (column epoch). `weights` are relative; by default they are the sources' sizes to the power `smoothing`.

Sources of any size: a stream is cut by the hash into buckets of about `bucket_rows` rows; running sums are taken in a
bucket and over the buckets' totals, so a source that holds a third of all rows is spread over many tasks.

Defined cases: null text has no bytes but counts as one; null source is a source of its own; null doc_id sorts as an
id; equal rows are taken as often as they occur; sources without a given weight get the smallest one; an empty table
gives an empty table; other columns pass through where `keep` names them.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.common import table, text_or_empty


def round_weights(weights: dict, period: int) -> dict:
    """Whole numbers of at least one that sum to period, by largest remainders."""
    total = sum(weights.values())
    share = {k: w / total * period for k, w in weights.items()}
    out = {k: max(1, math.floor(x)) for k, x in share.items()}
    by = sorted(out, key=lambda k: (-(share[k] - out[k]), str(k)))
    i = 0
    while (left := period - sum(out.values())) != 0:
        k = by[i % len(by)] if left > 0 else max(out, key=lambda k: (out[k], str(k)))
        out[k] += 1 if left > 0 else -1
        i += 1
    return out


def pfair(counts: list[int]) -> list[tuple[int, int]]:
    """(source, block) of each slot of one period; counts sum to the period."""
    period = sum(counts)
    waiting = sorted(((0, i, 0) for i in range(len(counts))), reverse=True)  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // counts[i]), i, j))
        _, i, j = heapq.heappop(ready)
        out.append((i, j))
        if j + 1 < counts[i]:
            heapq.heappush(waiting, ((j + 1) * period // counts[i], i, j + 1))
    return out


def mix(docs: DataFrame, weights: dict | None = None, smoothing: float = 0.9, block_bytes: int = 1 << 16, period: int = 4096, bucket_rows: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, epoch, block, slot, offset (of the document in its block's bytes), size, and the columns of
    keep. Order by (slot, offset) to read the mixture."""
    spark = docs.sparkSession
    key, size = F.col("source").cast("string"), F.greatest(F.octet_length(text_or_empty()), F.lit(1)).cast("long")
    totals = docs.groupBy(key.alias("source")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).limit(period + 1).collect()
    if len(totals) > period:
        raise ValueError(f"more than {period} sources; raise period")
    names = [r["source"] for r in sorted(totals, key=lambda r: (r["source"] is not None, r["source"] or ""))]
    by = {r["source"]: r for r in totals}
    given = weights or {s: by[s]["bytes"] ** smoothing for s in names}
    floor = min([w for w in given.values() if w > 0], default=1)
    counts = round_weights({s: given.get(s) or floor for s in names}, period) if names else {}
    blocks = {s: -(-by[s]["bytes"] // block_bytes) for s in names}
    slots = [(i, j, slot) for slot, (i, j) in enumerate(pfair([counts[s] for s in names]))]
    # the first slot after which every source has had all its blocks
    place: dict[tuple[int, int], int] = {(i, j): slot for i, j, slot in slots}
    last = lambda n, i, c: (n - 1) // c * period + place[i, (n - 1) % c]
    horizon = max((last(blocks[s], i, counts[s]) + 1 for i, s in enumerate(names)), default=0)

    # at most `period` sources and `period` slots: bounded tables
    facts = [(s, s is None, i, counts[s], by[s]["bytes"], max(1, -(-by[s]["rows"] // bucket_rows))) for i, s in enumerate(names)]
    sources = F.broadcast(spark.createDataFrame(facts, "s string, s_null boolean, source_no int, c int, source_bytes long, n_buckets long"))
    schedule = F.broadcast(spark.createDataFrame(slots, "slot_source int, slot_block long, slot_in_period int"))

    rank = F.xxhash64("doc_id", F.lit(3))
    rows = docs.select(F.col("doc_id"), key.alias("source"), size.alias("size"), rank.alias("__rank"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("s")))
    high = F.shiftrightunsigned("__rank", 33)  # 31 bits
    rows = rows.withColumn("bucket", F.floor(high * F.col("n_buckets") / float(1 << 31)))
    rows = rows.withColumn("in_bucket", F.sum("size").over(Window.partitionBy("source_no", "bucket").orderBy(high, "__rank", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    sums = docs.select(key.alias("source"), size.alias("size"), rank.alias("__rank")).join(sources, F.col("source").eqNullSafe(F.col("s")))
    sums = sums.groupBy("source_no", F.floor(F.shiftrightunsigned("__rank", 33) * F.col("n_buckets") / float(1 << 31)).alias("bucket")).agg(F.sum("size").alias("bucket_bytes"))
    before = sums.select(F.col("source_no").alias("b_source"), F.col("bucket").alias("b_bucket"), (F.sum("bucket_bytes").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("bucket_bytes")).alias("before"))
    rows = rows.join(before, (F.col("source_no") == F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))

    # epochs: the stream of a source repeats after its bytes, rounded up to whole blocks
    n_blocks = F.ceil(F.col("source_bytes") / block_bytes)
    at = F.col("before") + F.col("in_bucket")
    most = F.ceil((F.floor(F.lit(horizon) / period) + 1) * F.col("c") / n_blocks)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))))
    rows = rows.withColumn("block", (F.floor(at / block_bytes) + F.col("epoch") * n_blocks).cast("long")).withColumn("offset", at % block_bytes)
    rows = rows.join(schedule, (F.col("source_no") == F.col("slot_source")) & (F.col("block") % F.col("c") == F.col("slot_block")))
    rows = rows.withColumn("slot", (F.floor(F.col("block") / F.col("c")) * period + F.col("slot_in_period")).cast("long")).where(F.col("slot") < horizon)
    return rows.select("doc_id", "source", F.col("epoch").cast("int"), "block", "slot", "offset", "size", *[F.col(f"__keep_{c}").alias(c) for c in keep])


def op3_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
