"""Lossless transforms of numeric streams (stream_id, chunk_id, pos, value) and their inverses.

All work within (stream_id, chunk_id), the partitioning key of every window and aggregate, so they share one shuffle.
Values are unsigned of `bits` bits where that matters; 64-bit values are signed longs with the same bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["stream_id", "chunk_id"]


def in_order():
    return Window.partitionBy(*KEY).orderBy("pos")


def whole():
    return Window.partitionBy(*KEY)


def so_far():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def wrapped(x: Column, bits: int) -> Column:
    return x if bits >= 64 else F.pmod(x, F.lit(1 << bits))


def bit_length(x: Column) -> Column:
    """Bits of a value of 0 or more; 0 has one."""
    return F.length(F.conv(x.cast("string"), 10, 2))


def delta(df: DataFrame, bits: int = 64, step: int = 1) -> DataFrame:
    """The first `step` values stay, others become differences to the value `step` before."""
    before = F.lag("value", step).over(in_order())
    return df.select(*KEY, "pos", F.when(before.isNull(), F.col("value")).otherwise(wrapped(F.col("value") - before, bits)).alias("value"))


def undo_delta(df: DataFrame, bits: int = 64, step: int = 1) -> DataFrame:
    own = Window.partitionBy(*KEY, F.col("pos") % step).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(*KEY, "pos", wrapped(F.sum("value").over(own if step > 1 else so_far()), bits).alias("value"))


def zigzag(df: DataFrame) -> DataFrame:
    v = F.col("value")
    return df.withColumn("value", F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63)))


def undo_zigzag(df: DataFrame) -> DataFrame:
    v = F.col("value")
    return df.withColumn("value", F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1)))))


def width_for(x: Column) -> Column:
    """Smallest of 1, 2, 4, 8 bytes that holds an unsigned value."""
    return F.when((x >= 0) & (x < 1 << 8), 1).when((x >= 0) & (x < 1 << 16), 2).when((x >= 0) & (x < 1 << 32), 4).otherwise(8)


def range_pack(df: DataFrame) -> DataFrame:
    low, high = F.min("value").over(whole()), F.max("value").over(whole())
    return df.select(*KEY, "pos", (F.col("value") - low).alias("value"), low.alias("base"), width_for(high - low).alias("width"))


def undo_range_pack(df: DataFrame) -> DataFrame:
    return df.select(*KEY, "pos", (F.col("value") + F.col("base")).alias("value"))


def gcd(df: DataFrame) -> DataFrame:
    """Greatest common divisor of each chunk (stream_id, chunk_id, divisor): Euclid's steps over the distinct values."""
    step = lambda a, b: F.aggregate(F.sequence(F.lit(0), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))), lambda s: s["a"])
    few = df.groupBy(*KEY).agg(F.collect_set(F.abs("value")).alias("values"))
    return few.select(*KEY, F.aggregate("values", F.lit(0).cast("long"), step).alias("divisor"))


def divide_by(df: DataFrame, divisor: int = 0) -> DataFrame:
    """Divide by the parameter, or by the chunk's greatest common divisor where it is 0; a value that does not divide is an error."""
    d = gcd(df) if not divisor else df.select(*KEY).distinct().withColumn("divisor", F.lit(divisor).cast("long"))
    d = d.withColumn("divisor", F.when(F.col("divisor") == 0, 1).otherwise(F.col("divisor")))
    checked = F.when(F.col("value") % F.col("divisor") != 0, F.raise_error(F.lit("a value is not divisible")).cast("long")).otherwise(F.expr("value div divisor"))
    return df.join(d, KEY).select(*KEY, "pos", checked.alias("value"), "divisor")


def undo_divide_by(df: DataFrame) -> DataFrame:
    return df.select(*KEY, "pos", (F.col("value") * F.col("divisor")).alias("value"))


def byte_of(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))


def transpose_split(df: DataFrame, width: int = 4) -> DataFrame:
    """N values of `width` bytes as `width` byte streams (column lane: little end first)."""
    return df.select(*KEY, "pos", F.posexplode(F.array(*[byte_of(F.col("value"), i) for i in range(width)])).alias("lane", "value"))


def undo_transpose(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY, "pos").agg(F.sum(F.expr("shiftleft(value, 8 * lane)")).alias("value"))


def bit_split(df: DataFrame, widths: list[int]) -> DataFrame:
    """One column part_i for each width, lowest bits first."""
    at = [sum(widths[:i]) for i in range(len(widths))]
    return df.select(*KEY, "pos", *[F.shiftrightunsigned("value", a).bitwiseAND(F.lit((1 << w) - 1)).alias(f"part_{i}") for i, (a, w) in enumerate(zip(at, widths))])


def undo_bit_split(df: DataFrame, widths: list[int]) -> DataFrame:
    at = [sum(widths[:i]) for i in range(len(widths))]
    return df.select(*KEY, "pos", reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(f"part_{i}", a) for i, a in enumerate(at)]).alias("value"))


def bit_split_top8(df: DataFrame) -> DataFrame:
    """The chunk's effective width from its largest value; the top 8 of these bits, and the rest."""
    w = F.greatest(bit_length(F.max("value").over(whole())), F.lit(8)).alias("bits")
    rows = df.select(*KEY, "pos", "value", w)
    return rows.select(*KEY, "pos", "bits", F.expr("shiftright(value, bits - 8)").alias("top"), F.expr("value & (shiftleft(1L, bits - 8) - 1)").alias("rest"))


def float_parts(df: DataFrame, mantissa: int, exponent: int) -> DataFrame:
    """Fields of floats given as raw bits: sign, exponent, fraction, and sign in the lowest bit of the fraction (sign_fraction)."""
    v = F.col("value")
    sign, frac = F.shiftright(v, mantissa + exponent).bitwiseAND(F.lit(1)), v.bitwiseAND(F.lit((1 << mantissa) - 1))
    return df.select(*KEY, "pos", sign.alias("sign"), F.shiftright(v, mantissa).bitwiseAND(F.lit((1 << exponent) - 1)).alias("exponent"), frac.alias("fraction"), (F.shiftleft(frac, 1) + sign).alias("sign_fraction"))


def undo_float_parts(df: DataFrame, mantissa: int, exponent: int) -> DataFrame:
    return df.select(*KEY, "pos", (F.shiftleft("sign", mantissa + exponent) + F.shiftleft("exponent", mantissa) + F.shiftright("sign_fraction", 1)).alias("value"))


def quantize_offsets(df: DataFrame) -> DataFrame:
    """code = floor(log2 x) and the bits below; 0 is an error."""
    code = F.when(F.col("value") <= 0, F.raise_error(F.lit("0 cannot be quantised")).cast("int")).otherwise(bit_length(F.col("value")) - 1)
    return df.select(*KEY, "pos", "value", code.alias("code")).select(*KEY, "pos", "code", F.expr("value - shiftleft(1L, code)").alias("extra"))


def undo_quantize_offsets(df: DataFrame) -> DataFrame:
    return df.select(*KEY, "pos", F.expr("shiftleft(1L, code) + extra").alias("value"))


def quantize_lengths(df: DataFrame, direct: int = 32) -> DataFrame:
    """Values below `direct` are their own code; above it a code for each power of two, and the bits below."""
    power = direct.bit_length() - 1
    rows = df.select(*KEY, "pos", "value", (bit_length(F.col("value")) - 1).alias("log"))
    small = F.col("value") < direct
    return rows.select(*KEY, "pos", F.when(small, F.col("value")).otherwise(F.col("log") - power + direct).cast("int").alias("code"), F.when(small, 0).otherwise(F.expr("value - shiftleft(1L, log)")).cast("long").alias("extra"))


def undo_quantize_lengths(df: DataFrame, direct: int = 32) -> DataFrame:
    power = direct.bit_length() - 1
    return df.select(*KEY, "pos", F.when(F.col("code") < direct, F.col("code").cast("long")).otherwise(F.expr(f"shiftleft(1L, code - {direct} + {power}) + extra")).alias("value"))


def partition(df: DataFrame, bounds: list[int]) -> DataFrame:
    """Bucket and offset in it; bounds are the ascending starts of the buckets (at most 256), the first at or below all values."""
    if len(bounds) > 256 or sorted(set(bounds)) != list(bounds):
        raise ValueError("bounds must ascend and be 256 at most")
    v = F.col("value")
    bucket = reduce(lambda acc, i: acc.when(v >= bounds[i], i), range(len(bounds) - 2, -1, -1), F.when(v >= bounds[-1], len(bounds) - 1))
    start = reduce(lambda acc, i: acc.when(v >= bounds[i], F.lit(bounds[i])), range(len(bounds) - 2, -1, -1), F.when(v >= bounds[-1], F.lit(bounds[-1])))
    return df.select(*KEY, "pos", bucket.alias("bucket"), (v - start).alias("extra"))


def sentinel_byte(df: DataFrame) -> DataFrame:
    """Values below 255 in a byte; others become 255 and are exceptions, numbered in order."""
    out = F.col("value") >= 255
    nth = F.sum(out.cast("long")).over(so_far()) - 1
    return df.select(*KEY, "pos", F.when(out, 255).otherwise(F.col("value")).cast("long").alias("value"), F.when(out, F.col("value")).alias("exception"), F.when(out, nth).alias("exception_no"))


def sentinel_num(df: DataFrame, places: DataFrame, sentinel: int) -> DataFrame:
    """The values at listed places (stream_id, chunk_id, pos) become the sentinel and exceptions."""
    listed = places.select(*KEY, "pos", F.lit(True).alias("__listed"))
    hit = F.col("__listed").isNotNull()
    return df.join(listed, [*KEY, "pos"], "left").select(*KEY, "pos", F.when(hit, F.lit(sentinel).cast("long")).otherwise(F.col("value")).alias("value"), F.when(hit, F.col("value")).alias("exception"))


def sparse(df: DataFrame, dominant: Column | None = None) -> DataFrame:
    """Literals with the number of dominant values before each; a last row without a literal where dominant values trail."""
    common = F.lit(0).cast("long") if dominant is None else dominant
    rows = df.select(*KEY, "pos", "value", common.alias("dominant"), F.max("pos").over(whole()).alias("last"))
    kept = rows.where((F.col("value") != F.col("dominant")) | (F.col("pos") == F.col("last")))
    gap = F.col("pos") - F.coalesce(F.lag("pos").over(in_order()), F.lit(-1)) - 1
    tail = F.col("value") == F.col("dominant")
    return kept.select(*KEY, (F.row_number().over(in_order()) - 1).cast("long").alias("n"), (gap + tail.cast("int")).cast("long").alias("distance"), F.when(~tail, F.col("value")).alias("literal"), "dominant")


def sparse_auto(df: DataFrame, prefix: int = 4096) -> DataFrame:
    """sparse with the chunk's majority value: the one that more than half of its first `prefix` values hold, or else 0."""
    head = df.where(F.col("pos") < prefix)
    votes = head.groupBy(*KEY, "value").agg(F.count("*").alias("votes")).groupBy(*KEY).agg(F.max(F.struct("votes", "value")).alias("top"), F.sum("votes").alias("all"))
    chosen = votes.select(*KEY, F.when(F.col("top.votes") * 2 > F.col("all"), F.col("top.value")).otherwise(0).cast("long").alias("chosen"))
    return sparse(df.join(chosen, KEY), F.col("chosen"))


def undo_sparse(df: DataFrame) -> DataFrame:
    reach = F.sum(F.col("distance") + F.col("literal").isNotNull().cast("int")).over(Window.partitionBy(*KEY).orderBy("n"))
    rows = df.select(*KEY, "distance", "literal", "dominant", reach.alias("reach"))
    start = F.col("reach") - F.col("distance") - F.col("literal").isNotNull().cast("int")
    spread = rows.select(*KEY, "literal", "dominant", "reach", F.explode(F.sequence(start, F.col("reach") - 1)).alias("pos"))
    return spread.select(*KEY, "pos", F.when((F.col("pos") == F.col("reach") - 1) & F.col("literal").isNotNull(), F.col("literal")).otherwise(F.col("dominant")).alias("value"))


def run_lengths(df: DataFrame) -> DataFrame:
    """Maximal runs of equal values: n, start, value, length."""
    before = F.lag("value").over(in_order())
    heads = df.select(*KEY, "pos", "value", F.max("pos").over(whole()).alias("last"), before.eqNullSafe(F.col("value")).alias("same")).where((F.col("pos") == 0) | ~F.col("same"))
    end = F.coalesce(F.lead("pos").over(in_order()), F.col("last") + 1)
    return heads.select(*KEY, (F.row_number().over(in_order()) - 1).cast("long").alias("n"), F.col("pos").alias("start"), "value", (end - F.col("pos")).alias("length"))


def undo_run_lengths(df: DataFrame) -> DataFrame:
    return df.select(*KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"), "value")


def merge_sorted(df: DataFrame, limit: int = 64) -> DataFrame:
    """Strictly increasing runs as one sorted union with a set of runs for each value; more than `limit` runs are an error."""
    falls = (F.col("value") <= F.lag("value").over(in_order())).cast("int")
    rows = df.select(*KEY, "value", F.sum(F.coalesce(falls, F.lit(0))).over(so_far()).alias("run"))
    bit = F.when(F.col("run") >= limit, F.raise_error(F.lit("too many runs")).cast("long")).otherwise(F.expr("shiftleft(1L, cast(run as int))"))
    return rows.groupBy(*KEY, "value").agg(F.bit_or(bit).alias("members"))


def tokenize(df: DataFrame, in_order: bool = True) -> tuple[DataFrame, DataFrame]:
    """Alphabet (stream_id, chunk_id, token, value) and tokens of the stream; sorted, or in the order of first sight."""
    firsts = df.groupBy(*KEY, "value").agg(F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("value" if in_order else "first")) - 1
    alphabet = firsts.select(*KEY, rank.cast("long").alias("token"), "value")
    tokens = df.join(alphabet, [*KEY, "value"]).select(*KEY, "pos", F.col("token").alias("value"))
    return alphabet, tokens


def undo_tokenize(alphabet: DataFrame, tokens: DataFrame) -> DataFrame:
    return tokens.withColumnRenamed("value", "token").join(alphabet, [*KEY, "token"]).select(*KEY, "pos", "value")


def concat(inputs: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Inputs one after the other within each chunk, and the sizes of the inputs."""
    both = reduce(DataFrame.unionByName, [df.withColumn("input_no", F.lit(i)) for i, df in enumerate(inputs)])
    at = F.row_number().over(Window.partitionBy("chunk_id").orderBy("input_no", "pos")) - 1
    return both.select("chunk_id", at.cast("long").alias("pos"), "value"), both.groupBy("chunk_id", "input_no").agg(F.count("*").alias("size"))


def interleave(inputs: list[DataFrame]) -> DataFrame:
    """Round robin over streams of equal length."""
    both = reduce(DataFrame.unionByName, [df.withColumn("input_no", F.lit(i)) for i, df in enumerate(inputs)])
    return both.select("chunk_id", (F.col("pos") * len(inputs) + F.col("input_no")).alias("pos"), "value")


def dedup(inputs: list[DataFrame], trusted: bool = False) -> DataFrame:
    """One copy of inputs that must all be identical (unless trusted)."""
    if trusted:
        return inputs[0].select("chunk_id", "pos", "value")
    both = reduce(DataFrame.unionByName, inputs)
    same = (F.count_distinct("value") <= 1) & (F.count("*") == len(inputs))
    value = F.when(same, F.first("value")).otherwise(F.raise_error(F.lit("inputs differ")))
    return both.groupBy("chunk_id", "pos").agg(value.alias("value"))


def constant(df: DataFrame) -> DataFrame:
    """value and count of the chunks that hold one value only."""
    return df.groupBy(*KEY).agg(F.min("value").alias("value"), F.max("value").alias("high"), F.count("*").alias("count")).where("value = high").drop("high")


def split_n(df: DataFrame, sizes: list[int]) -> DataFrame:
    """segment and place in it; a last size of 0 stands for the rest."""
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    if sizes[-1] == 0:
        ends[-1] = 1 << 62
    pos = F.col("pos")
    segment, start = F.when(pos < ends[0], 0), F.when(pos < ends[0], 0)
    for i in range(1, len(ends)):
        segment, start = segment.when(pos < ends[i], i), start.when(pos < ends[i], ends[i - 1])
    beyond = F.raise_error(F.lit("sizes do not cover the stream")).cast("int")
    return df.select(*KEY, segment.otherwise(beyond).alias("segment"), (pos - start).alias("pos"), "value")


def split_by_range(df: DataFrame, width: int = 4, confirm: int = 7) -> DataFrame:
    """Cuts between blocks (of 128, 64 and 32 values for elements of 1, 2 and more bytes) whose values do not overlap: all of the `confirm` blocks before lie below or above all that follow."""
    block = {1: 128, 2: 64}.get(width, 32)
    blocks = df.groupBy(*KEY, F.expr(f"pos div {block}").alias("block")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    w = Window.partitionBy(*KEY).orderBy("block")
    back, ahead = w.rowsBetween(-confirm, -1), w.rowsBetween(0, confirm - 1)
    cut = (F.max("high").over(back) < F.min("low").over(ahead)) | (F.min("low").over(back) > F.max("high").over(ahead))
    marked = blocks.select(*KEY, "block", F.coalesce(cut, F.lit(False)).cast("int").alias("cut"))
    segment = F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.select(*KEY, "block", segment.alias("segment"))


def mux_lengths(df: DataFrame, split: int, bias: int = 0) -> DataFrame:
    """(literal, match) in a byte: literal in the low `split` bits, match above; what does not fit overflows."""
    low, high = (1 << split) - 1, (1 << (8 - split)) - 1
    m = F.col("match") - bias
    return df.select(*KEY, "pos", (F.least("literal", F.lit(low)) + F.shiftleft(F.least(m, F.lit(high)), split)).alias("code"), F.when(F.col("literal") >= low, F.col("literal") - low).alias("literal_over"), F.when(m >= high, m - high).alias("match_over"))


def best_split(df: DataFrame, bias: int = 0) -> DataFrame:
    """The split with the fewest overflows of each chunk (ties: the smaller)."""
    m = F.col("match") - bias
    over = [F.sum((F.col("literal") >= (1 << s) - 1).cast("long") + (m >= (1 << (8 - s)) - 1).cast("long")).alias(f"s{s}") for s in range(9)]
    sums = df.groupBy(*KEY).agg(*over)
    least = F.array_min(F.array(*[F.struct(F.col(f"s{s}").alias("over"), F.lit(s).alias("split")) for s in range(9)]))
    return sums.select(*KEY, least["split"].alias("split"), least["over"].alias("over"))


def dispatch(df: DataFrame, tag: Column) -> DataFrame:
    """Each value goes to the output of its tag and keeps its order there (out_pos)."""
    rows = df.select(*KEY, "pos", tag.alias("tag"), "value")
    at = F.row_number().over(Window.partitionBy(*KEY, "tag").orderBy("pos")) - 1
    return rows.select(*KEY, "pos", "tag", at.cast("long").alias("out_pos"), "value")


def dispatched(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What dispatch stores: the stream of tags (pos, tag) and the outputs (tag, out_pos, value)."""
    return df.select(*KEY, "pos", "tag"), df.select(*KEY, "tag", "out_pos", "value")


def undo_dispatch(tags: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each tag takes the next value of its output."""
    at = F.row_number().over(Window.partitionBy(*KEY, "tag").orderBy("pos")) - 1
    return tags.withColumn("out_pos", at.cast("long")).join(outputs, [*KEY, "tag", "out_pos"]).select(*KEY, "pos", "value")


def little_endian_bytes(df: DataFrame, width: int, big: bool = False) -> DataFrame:
    """Numbers as bytes (a serial stream)."""
    lanes = [byte_of(F.col("value"), i) for i in (range(width - 1, -1, -1) if big else range(width))]
    return df.select(*KEY, "pos", F.posexplode(F.array(*lanes)).alias("i", "b")).select(*KEY, (F.col("pos") * width + F.col("i")).alias("pos"), F.col("b").alias("value"))


def from_bytes(df: DataFrame, width: int, big: bool = False) -> DataFrame:
    """Bytes as numbers of `width` bytes; a length that does not divide is an error."""
    shift = F.col("pos") % width
    shift = (width - 1 - shift if big else shift) * 8
    part = df.select(*KEY, F.expr(f"pos div {width}").alias("n"), F.col("value"), shift.cast("int").alias("shift"))
    whole = part.groupBy(*KEY, "n").agg(F.sum(F.expr("shiftleft(value, shift)")).alias("value"), F.count("*").alias("c"))
    return whole.select(*KEY, F.col("n").alias("pos"), F.when(F.col("c") == width, F.col("value")).otherwise(F.raise_error(F.lit("bytes are left over")).cast("long")).alias("value"))


def bit_pack(df: DataFrame) -> DataFrame:
    """bits, count and the packed bytes of each chunk, as few bits a value as its largest one needs (lowest bits first)."""
    rows = df.groupBy(*KEY).agg(bit_length(F.max("value")).alias("bits"), F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("rows"))
    text = F.array_join(F.reverse(F.transform("rows", lambda r: F.lpad(F.conv(r["value"].cast("string"), 10, 2), F.col("bits").cast("int"), "0"))), "")
    rows = rows.select(*KEY, "bits", "count", text.alias("text")).withColumn("size", F.ceil(F.length("text") / 8))
    padded = F.lpad("text", (F.col("size") * 8).cast("int"), "0")
    each = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.lpad(F.conv(F.substr(padded, (F.col("size") - 1 - i).cast("int") * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return rows.select(*KEY, "bits", "count", F.array_join(each, "").alias("packed_hex"))


def bit_unpack(df: DataFrame) -> DataFrame:
    text = F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.expr("cast(length(packed_hex) div 2 as int) - 1")), lambda i: F.lpad(F.conv(F.substr("packed_hex", (2 * i + 1).cast("int"), F.lit(2)), 16, 2), 8, "0"))), "")
    rows = df.select(*KEY, "bits", "count", text.alias("text"))
    value = F.conv(F.substr("text", (F.length("text") - (F.col("pos") + 1) * F.col("bits") + 1).cast("int"), F.col("bits").cast("int")), 2, 10).cast("long")
    return rows.select(*KEY, "bits", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("pos")).select(*KEY, "pos", value.alias("value"))


def byteswap(df: DataFrame, bits: int) -> DataFrame:
    """Integers of 16, 32 or 64 bits with their bytes in reverse; its own inverse. 16 and 32 bits are unsigned."""
    n = bits // 8
    out = F.lit(0).cast("long")
    for i in range(n):
        out = out.bitwiseOR(F.shiftleft(byte_of(F.col("value"), i), 8 * (n - 1 - i)))
    return df.select(*KEY, "pos", out.alias("value"))
