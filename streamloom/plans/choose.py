"""Choice of an encoding from statistics: plans are rows of costs, and the cheapest is picked in a window or by CASE."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.operators.numeric import KEY


def entropy_choice(sizes: DataFrame) -> DataFrame:
    """Encoding of each chunk of bytes from profile.sizes: the first of equally small ones in the order store, bitpack, flatpack,
    huffman, constant; entropy coding is not tried up to 64 elements, and a gain of max(32 bytes, 1 %) is asked of it."""
    n = F.col("n")
    gain = F.greatest(F.lit(32), F.ceil(n / 100.0))
    entropy = F.when((n > 64) & (F.col("huffman") + gain <= n), F.col("huffman"))
    flat = F.when((F.col("flatpack") < F.col("bitpack")) & (F.col("flatpack") < n), F.col("flatpack"))
    bit = F.when(F.col("bitpack") < n, F.col("bitpack"))
    cheapest = F.coalesce(F.least(entropy, flat, bit, n), n)
    choice = (
        F.when(n <= 1, "store").when(F.col("cardinality") == 1, "constant")
        .when(flat == cheapest, "flatpack").when(bit == cheapest, "bitpack").when(entropy == cheapest, "huffman").otherwise("store")
    )
    return sizes.select(*KEY, "n", choice.alias("choice"), F.when(F.col("cardinality") == 1, F.least(F.col("constant"), n)).otherwise(cheapest).alias("cost"))


def brute_force(candidates: DataFrame) -> DataFrame:
    """The strictly smallest of the candidates (columns candidate_no, candidate, size) of each chunk; none below the store's size: store."""
    best = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("size").asc_nulls_last(), "candidate_no"))
    return candidates.withColumn("rank", best).where("rank = 1").select(*KEY, "candidate", "size")


def by_type(catalog: DataFrame) -> DataFrame:
    """What a stream's type is sent to."""
    kind = F.col("type")
    return catalog.withColumn("graph", F.when(kind == "serial", "zstd").when(kind == "struct", "field_lz").when(kind == "numeric", "field_lz").when(kind == "string", "separate_zstd"))


def cluster(inputs: DataFrame, config: DataFrame) -> DataFrame:
    """Cluster of each input (input_no, tag, type, width): the configured one of its tag, or one of its own for each other tag."""
    known = config.select(F.col("tag").alias("c_tag"), F.col("type").alias("c_type"), F.col("width").alias("c_width"), "cluster")
    joined = inputs.join(known, (F.col("tag") == F.col("c_tag")) & (F.col("type") == F.col("c_type")) & (F.col("width") == F.col("c_width")), "left")
    own = F.concat_ws("-", F.lit("tag"), "tag", "type", "width")
    return joined.select("input_no", "tag", "type", "width", F.coalesce("cluster", own).alias("cluster"))


def two_byte_choice(df: DataFrame) -> DataFrame:
    """Choice for integers of 2 bytes: constant; bit packing where it saves and a Huffman code does not save more; store above 15 bits
    of entropy or without a gain; a dictionary and Huffman code of bytes below 256 symbols, else a Huffman code of integers."""
    counts = df.groupBy(*KEY, "value").agg(F.count("*").alias("c"))
    s = counts.groupBy(*KEY).agg(F.sum("c").alias("n"), F.count("*").alias("cardinality"), F.max("value").alias("top"), F.sum(F.col("c") * F.log2("c")).alias("clog"))
    s = s.withColumn("entropy", F.round(F.log2("n") - F.col("clog") / F.col("n"), 9))
    s = s.withColumn("store", 2 * F.col("n"))
    s = s.withColumn("bitpack", F.ceil(F.col("n") * F.greatest(F.floor(F.log2(F.greatest("top", F.lit(1)))) + 1, F.lit(1)) / 8))
    s = s.withColumn("huffman", F.ceil(F.greatest(F.lit(1.0), F.col("entropy")) * F.col("n") / 8) + F.greatest(F.lit(100), F.expr("top div 4")))
    choice = (
        F.when(F.col("cardinality") == 1, "constant").when((F.col("bitpack") <= F.col("huffman")) & (F.col("bitpack") < F.col("store")), "bitpack")
        .when((F.col("entropy") > 15) | (F.col("huffman") >= F.col("store")), "store").when(F.col("cardinality") < 256, "tokenize_huffman").otherwise("huffman_struct")
    )
    return s.select(*KEY, "n", "cardinality", choice.alias("choice"))


def merged_contexts(histograms: DataFrame, loss: float = 64.0) -> DataFrame:
    """Contexts (stream_id, context, symbol, n) in clusters whose symbols share one code: stream_id, context, cluster (its least
    context). The pair whose union adds the fewest bits is merged again and again, as long as it adds fewer than `loss` bits (what a
    table of counts would cost); ties go to the least pair. A context is a byte, so a stream has 256 of them at most."""
    rows = histograms.select("stream_id", F.col("context").cast("long"), F.col("symbol").cast("long"), F.col("n").cast("long"))

    def merge(group):
        import numpy as np
        import pandas as pd

        symbols = {s: i for i, s in enumerate(sorted(group["symbol"].unique()))}
        tables: dict[int, np.ndarray] = {}
        for c, s, n in zip(group["context"], group["symbol"], group["n"]):
            tables.setdefault(int(c), np.zeros(len(symbols)))[symbols[s]] += n
        members = {c: [c] for c in tables}

        def bits(t):
            t = t[t > 0]
            return float((t * np.log2(t.sum() / t)).sum())

        cost = {c: bits(t) for c, t in tables.items()}
        added = {(a, b): bits(tables[a] + tables[b]) - cost[a] - cost[b] for a in tables for b in tables if a < b}
        while added:
            a, b = min(added, key=lambda p: (round(added[p], 6), p))
            if added[a, b] >= loss:
                break
            tables[a] = tables[a] + tables.pop(b)
            members[a] += members.pop(b)
            cost[a] = bits(tables[a])
            added = {p: v for p, v in added.items() if a not in p and b not in p}
            added |= {(min(a, c), max(a, c)): bits(tables[a] + tables[c]) - cost[a] - cost[c] for c in tables if c != a}
        out = [(group["stream_id"].iloc[0], c, k) for k, m in members.items() for c in m]
        return pd.DataFrame(out, columns=["stream_id", "context", "cluster"])

    return rows.groupBy("stream_id").applyInPandas(merge, "stream_id string, context long, cluster long")
