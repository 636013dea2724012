"""Statistics of streams: one aggregate for each, with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.operators.numeric import KEY, bit_length, in_order


def value_range(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.min("value").alias("low"), F.max("value").alias("high"), (F.max("value") - F.min("value")).alias("range_size"))


def moments(df: DataFrame, digits: int = 4) -> DataFrame:
    """Mean, sample variance and deviation, skewness and kurtosis (biased, less 3); up to one value: zeros."""
    v = F.col("value").cast("double")
    n = F.count("*")
    few = lambda x: F.when(n <= 1, F.lit(0.0)).otherwise(F.round(x, digits))
    return df.groupBy(*KEY).agg(n.alias("n"), few(F.avg(v)).alias("mean"), few(F.var_samp(v)).alias("variance"), few(F.stddev_samp(v)).alias("stddev"), few(F.skewness(v)).alias("skewness"), few(F.kurtosis(v)).alias("kurtosis"))


def cardinality(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.count_distinct("value").alias("cardinality"))


def approximate_cardinality(df: DataFrame, error: float = 0.02) -> DataFrame:
    return df.groupBy(*KEY).agg(F.approx_count_distinct("value", error).alias("cardinality"))


def linear_counting_error(df: DataFrame, buckets: int = 1024) -> DataFrame:
    """Estimate by the share of empty hash buckets, and its error bound 2 * max(0.1, sqrt(m) * sqrt(e^t - t - 1) / n)."""
    rows = df.groupBy(*KEY).agg(F.count_distinct("value").alias("n"), F.count_distinct(F.pmod(F.xxhash64("value"), F.lit(buckets))).alias("full"))
    t = F.col("n") / buckets
    bound = 2 * F.greatest(F.lit(0.1), F.sqrt(F.lit(float(buckets))) * F.sqrt(F.exp(t) - t - 1) / F.col("n"))
    return rows.select(*KEY, "n", F.when(F.col("full") < buckets, -buckets * F.log(1 - F.col("full") / buckets)).alias("estimate"), bound.alias("bound"))


def histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY, "value").agg(F.count("*").alias("count"))


def byte_deltas(df: DataFrame) -> DataFrame:
    before = F.lag("value").over(in_order())
    return df.select(*KEY, "pos", F.pmod(F.col("value") - before, F.lit(256)).alias("value")).where("value IS NOT NULL")


def entropy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Shannon entropy in bits a value."""
    counts = histogram(df)
    total = F.sum("count")
    # -sum p log p = log n - sum c log c / n
    e = F.log2(total.cast("double")) - F.sum(F.col("count") * F.log2(F.col("count").cast("double"))) / total
    return counts.groupBy(*KEY).agg(total.alias("n"), F.count("*").alias("cardinality"), F.max("value").alias("top"), F.abs(F.round(e, digits)).alias("entropy"))


def bits_for_count(x: Column) -> Column:
    """Bits that number x different things: ceil(log2 x), one at least."""
    return F.greatest(bit_length(x - 1), F.lit(1))


def sizes(df: DataFrame) -> DataFrame:
    """Estimated bytes of a chunk of bytes under each encoding (null: not possible), with what they rest on."""
    e = entropy(df)
    n, card, top, h = F.col("n"), F.col("cardinality"), F.col("top"), F.col("entropy")
    varint = F.ceil(bit_length(n) / 7.0)
    huffman = 9 + F.ceil(F.least(5 * card, 4 * (top + 1)) / 8.0) + F.floor(F.greatest(h, F.lit(1.0)) * n / 8)
    return e.select(
        *KEY, "n", "cardinality", "top", "entropy", n.alias("store"),
        F.ceil(n * bit_length(top) / 8.0).cast("long").alias("bitpack"),
        F.when(card <= 128, F.ceil(n * bits_for_count(card) / 8.0) + card).cast("long").alias("flatpack"),
        F.when(card == 1, 1 + varint).cast("long").alias("constant"), huffman.cast("long").alias("huffman"),
    )


def features(df: DataFrame, width: int = 8) -> DataFrame:
    """The features that a numeric selector looks at."""
    v = F.col("value").cast("double")
    r = lambda x: F.round(x, 4)
    return df.groupBy(*KEY).agg(F.count("*").alias("n"), F.lit(width).alias("elt_width"), F.count_distinct("value").alias("cardinality"), (F.max("value") - F.min("value")).alias("range_size"), r(F.avg(v)).alias("mean"), r(F.var_samp(v)).alias("variance"), r(F.skewness(v)).alias("skewness"), r(F.kurtosis(v)).alias("kurtosis"))


def stride_matches(df: DataFrame, strides: tuple[int, ...] = (1, 2, 3, 4, 8, 16)) -> DataFrame:
    """How many values equal the one `stride` before, for each stride: its peak is the stream's dimension."""
    rows = df.select(*KEY, *[(F.lag("value", k).over(in_order()) == F.col("value")).cast("long").alias(f"s{k}") for k in strides])
    sums = rows.groupBy(*KEY).agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0)).alias(f"s{k}") for k in strides])
    return sums.select(*KEY, F.explode(F.array(*[F.struct(F.lit(k).alias("stride"), F.col(f"s{k}").alias("matches")) for k in strides])).alias("m")).select(*KEY, "m.stride", "m.matches")


def guess_width(df: DataFrame, widths: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Element width of a byte stream: the one whose lanes have the least entropy together (ties: the smaller)."""
    lanes = df.select(*KEY, "value", F.explode(F.array(*[F.struct(F.lit(w).alias("width"), (F.col("pos") % w).alias("lane")) for w in widths])).alias("l"))
    counts = lanes.groupBy(*KEY, "l.width", "l.lane", "value").agg(F.count("*").alias("c"))
    each = counts.groupBy(*KEY, "width", "lane").agg((F.sum("c") * F.log2(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double")))).alias("bits"))
    total = each.groupBy(*KEY, "width").agg(F.round(F.sum("bits"), 4).alias("bits"))
    best = total.groupBy(*KEY).agg(F.min(F.struct("bits", "width")).alias("best"))
    return best.select(*KEY, "best.width", "best.bits")


def reductions(df: DataFrame, limit: int) -> DataFrame:
    """Sum, maximum, whether all lie below the limit, and the least width that holds the maximum."""
    from streamloom.operators.numeric import width_for

    return df.groupBy(*KEY).agg(F.sum("value").alias("total"), F.max("value").alias("top"), F.bool_and(F.col("value") < limit).alias("all_below"), width_for(F.max("value")).alias("width"))


def checksums(df: DataFrame, key: str, content: str) -> DataFrame:
    b = F.col(content).cast("binary")
    return df.select(key, F.crc32(b).alias("crc32"), F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"))


def pareto(df: DataFrame, key: str, small: str, fast: str) -> DataFrame:
    """Rows that no other one beats: none is as small and faster, or smaller and as fast. One global window: for result tables."""
    w = Window.orderBy(F.col(small), F.desc(fast), F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__best", F.max(fast).over(w)).where(F.col("__best").isNull() | (F.col(fast) > F.col("__best"))).drop("__best")
