"""Queries of the encoding and profiling operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamloom.operators import numeric as N
from streamloom.operators import profile as P
from streamloom.operators import strings as S
from streamloom.operators import structs as T
from streamloom.sources import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: streams in SQL
STREAMS = """
price AS (SELECT 'price' AS stream_id, o_orderkey // 1024 AS chunk_id, row_number() OVER (PARTITION BY o_orderkey // 1024 ORDER BY o_orderkey) - 1 AS pos, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders),
days AS (SELECT 'day' AS stream_id, o_orderkey // 1024 AS chunk_id, row_number() OVER (PARTITION BY o_orderkey // 1024 ORDER BY o_orderkey) - 1 AS pos, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS value FROM orders),
usr AS (SELECT 'user' AS stream_id, event_id // 1024 AS chunk_id, row_number() OVER (PARTITION BY event_id // 1024 ORDER BY event_id) - 1 AS pos, user_id AS value FROM events),
sparse AS (SELECT 'sparse' AS stream_id, event_id // 1024 AS chunk_id, row_number() OVER (PARTITION BY event_id // 1024 ORDER BY event_id) - 1 AS pos, CASE WHEN event_id % 5 = 0 THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS value FROM events),
etype AS (SELECT 'event_type' AS stream_id, event_id // 1024 AS chunk_id, row_number() OVER (PARTITION BY event_id // 1024 ORDER BY event_id) - 1 AS pos, event_type AS value FROM events),
prio AS (SELECT 'priority' AS stream_id, o_orderkey // 1024 AS chunk_id, row_number() OVER (PARTITION BY o_orderkey // 1024 ORDER BY o_orderkey) - 1 AS pos, o_orderpriority AS value FROM orders),
pname AS (SELECT 'p_name' AS stream_id, p_partkey // 1024 AS chunk_id, row_number() OVER (PARTITION BY p_partkey // 1024 ORDER BY p_name, p_partkey) - 1 AS pos, p_name AS value FROM part),
props_hex AS (SELECT event_id AS chunk_id, hex(encode(props)) AS h FROM events),
bytes AS (SELECT 'props' AS stream_id, chunk_id, i AS pos, (strpos('0123456789ABCDEF', substr(h, CAST(2 * i + 1 AS INT), 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, CAST(2 * i + 2 AS INT), 1)) - 1 AS value FROM (SELECT chunk_id, h, unnest(range(length(h) // 2)) AS i FROM props_hex))
"""
K, W = "stream_id, chunk_id", "PARTITION BY stream_id, chunk_id ORDER BY pos"


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql if sql.lstrip().startswith("WITH") else f"WITH {STREAMS} {sql}"
        return f

    return keep


IDENTITY = f"SELECT {K}, pos, value FROM price"


@query(IDENTITY)
def stream_typed(s, d):
    return streams.price(s, d)


@query("SELECT stream_id, 'numeric' AS type, 8 AS elt_width, count(DISTINCT chunk_id) AS chunks, count(*) AS elements FROM price GROUP BY 1")
def stream_catalog(s, d):
    return streams.catalog_of(streams.price(s, d), "numeric", 8)


@query(f"SELECT {K}, pos, coalesce((value - lag(value) OVER (w) + 4294967296) % 4294967296, value) AS value FROM price WINDOW w AS ({W})")
def delta_int(s, d):
    return N.delta(streams.price(s, d), bits=32)


@query(IDENTITY)
def delta_int_decode(s, d):
    return N.undo_delta(N.delta(streams.price(s, d), bits=32), bits=32)


@query(f"SELECT {K}, pos, coalesce(value - lag(value, 4) OVER (w), value) AS value FROM price WINDOW w AS ({W})")
def delta_step(s, d):
    return N.delta(streams.price(s, d), step=4)


@query(IDENTITY)
def delta_step_decode(s, d):
    return N.undo_delta(N.delta(streams.price(s, d), step=4), step=4)


@query(f"SELECT {K}, pos, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS value FROM (SELECT {K}, pos, coalesce(value - lag(value) OVER (w), value) AS v FROM price WINDOW w AS ({W}))")
def zigzag(s, d):
    return N.zigzag(N.delta(streams.price(s, d)))


@query(IDENTITY)
def zigzag_decode(s, d):
    return N.undo_delta(N.undo_zigzag(N.zigzag(N.delta(streams.price(s, d)))))


@query(f"SELECT {K}, pos, lane, (value >> (8 * lane)) & 255 AS value FROM price, (SELECT unnest([0, 1, 2, 3]) AS lane)")
def transpose_split(s, d):
    return N.transpose_split(streams.price(s, d), 4)


@query(IDENTITY)
def transpose_decode(s, d):
    return N.undo_transpose(N.transpose_split(streams.price(s, d), 4))


@query(f"SELECT {K}, pos, value - base AS value, base, CASE WHEN r < 256 THEN 1 WHEN r < 65536 THEN 2 WHEN r < 4294967296 THEN 4 ELSE 8 END AS width FROM (SELECT *, min(value) OVER (p) AS base, max(value) OVER (p) - min(value) OVER (p) AS r FROM price WINDOW p AS (PARTITION BY stream_id, chunk_id))")
def range_pack(s, d):
    return N.range_pack(streams.price(s, d))


@query(IDENTITY)
def range_pack_decode(s, d):
    return N.undo_range_pack(N.range_pack(streams.price(s, d)))


FIFTIES = f"fifties AS (SELECT {K}, pos, value * 50 AS value FROM usr)"


@query(f", {FIFTIES}, g AS (SELECT {K}, list_reduce(list_distinct(list(value)), lambda a, b: gcd(a, b)) AS divisor FROM fifties GROUP BY ALL) SELECT {K}, pos, value // divisor AS value, divisor FROM fifties JOIN g USING ({K})")
def divide_by(s, d):
    return N.divide_by(streams.user(s, d).withColumn("value", F.col("value") * 50))


@query(f"SELECT {K}, pos, value * 50 AS value FROM usr")
def divide_by_decode(s, d):
    return N.undo_divide_by(N.divide_by(streams.user(s, d).withColumn("value", F.col("value") * 50)))


@query(f"SELECT {K}, pos, value & 255 AS part_0, (value >> 8) & 4095 AS part_1, (value >> 20) & 4095 AS part_2 FROM price")
def bit_split(s, d):
    return N.bit_split(streams.price(s, d), [8, 12, 12])


@query(IDENTITY)
def bit_split_decode(s, d):
    return N.undo_bit_split(N.bit_split(streams.price(s, d), [8, 12, 12]), [8, 12, 12])


@query(f"SELECT {K}, pos, bits, value >> (bits - 8) AS top, value & ((1::BIGINT << (bits - 8)) - 1) AS rest FROM (SELECT *, greatest(length(bin(max(value) OVER (PARTITION BY stream_id, chunk_id))), 8)::INT AS bits FROM price)")
def bit_split_top8(s, d):
    return N.bit_split_top8(streams.price(s, d))


def float_sql(mantissa: int, exponent: int, mask: int) -> str:
    return f"SELECT {K}, pos, (v >> {mantissa + exponent}) & 1 AS sign, (v >> {mantissa}) & {(1 << exponent) - 1} AS exponent, v & {(1 << mantissa) - 1} AS fraction, ((v & {(1 << mantissa) - 1}) << 1) + ((v >> {mantissa + exponent}) & 1) AS sign_fraction FROM (SELECT *, value & {mask} AS v FROM price)"


@query(float_sql(23, 8, 0xFFFFFFFF))
def float32_deconstruct(s, d):
    return N.float_parts(streams.price(s, d).withColumn("value", F.expr("value & 4294967295")), 23, 8)


@query(float_sql(7, 8, 0xFFFF))
def bfloat16_deconstruct(s, d):
    return N.float_parts(streams.price(s, d).withColumn("value", F.expr("value & 65535")), 7, 8)


@query(float_sql(10, 5, 0xFFFF))
def float16_deconstruct(s, d):
    return N.float_parts(streams.price(s, d).withColumn("value", F.expr("value & 65535")), 10, 5)


@query(f"SELECT {K}, pos, value & 4294967295 AS value FROM price")
def float32_reconstruct(s, d):
    return N.undo_float_parts(float32_deconstruct(s, d), 23, 8)


@query(f"SELECT {K}, pos, (length(bin(value)) - 1)::INT AS code, value - (1::BIGINT << (length(bin(value)) - 1)::INT) AS extra FROM price WHERE value > 0")
def quantize_offsets(s, d):
    return N.quantize_offsets(streams.price(s, d).where("value > 0"))


@query(f"SELECT {K}, pos, value FROM price WHERE value > 0")
def quantize_offsets_decode(s, d):
    return N.undo_quantize_offsets(quantize_offsets(s, d))


LENGTHS = f"lengths AS (SELECT {K}, pos, value % 100 AS value FROM usr)"


@query(f", {LENGTHS} SELECT {K}, pos, CASE WHEN value < 32 THEN value ELSE length(bin(value)) - 1 - 5 + 32 END::INT AS code, CASE WHEN value < 32 THEN 0 ELSE value - (1::BIGINT << (length(bin(value)) - 1)::INT) END AS extra FROM lengths")
def quantize_lengths(s, d):
    return N.quantize_lengths(streams.user(s, d).withColumn("value", F.col("value") % 100))


@query(f", {LENGTHS} SELECT {K}, pos, value FROM lengths")
def quantize_lengths_decode(s, d):
    return N.undo_quantize_lengths(quantize_lengths(s, d))


BOUNDS = [0, 10, 100, 5000, 1000000, 20000000]


@query(f", b AS (SELECT unnest(range(6)) AS i, unnest({BOUNDS}) AS lo) SELECT {K}, pos, max(i)::INT AS bucket, value - max(lo) AS extra FROM price JOIN b ON value >= lo GROUP BY {K}, pos, value")
def partition_buckets(s, d):
    return N.partition(streams.price(s, d), BOUNDS)


@query(f", x AS (SELECT *, row_number() OVER ({W}) - 1 AS n FROM usr WHERE value >= 255) SELECT u.stream_id, u.chunk_id, u.pos, least(u.value, 255) AS value, x.value AS exception, x.n AS exception_no FROM usr u LEFT JOIN x USING ({K}, pos)")
def sentinel_byte(s, d):
    return N.sentinel_byte(streams.user(s, d))


@query(f"SELECT {K}, pos, CASE WHEN pos % 7 = 3 THEN -1 ELSE value END AS value, CASE WHEN pos % 7 = 3 THEN value END AS exception FROM usr")
def sentinel_num(s, d):
    rows = streams.user(s, d)
    return N.sentinel_num(rows, rows.where("pos % 7 = 3"), -1)


def sparse_sql(source: str) -> str:
    return f"""SELECT {K}, row_number() OVER ({W}) - 1 AS n, pos - coalesce(lag(pos) OVER ({W}), -1) - 1 + (value = dominant)::INT AS distance, CASE WHEN value <> dominant THEN value END AS literal, dominant
    FROM (SELECT *, max(pos) OVER (PARTITION BY stream_id, chunk_id) AS last FROM {source}) WHERE value <> dominant OR pos = last"""


@query(f", d AS (SELECT *, 0::BIGINT AS dominant FROM sparse) {sparse_sql('d')}")
def sparse_num(s, d):
    return N.sparse(streams.clicks(s, d))


@query(f"SELECT {K}, pos, value FROM sparse")
def sparse_num_decode(s, d):
    return N.undo_sparse(N.sparse(streams.clicks(s, d)))


MOSTLY = f"mostly AS (SELECT {K}, pos, CASE WHEN value = 0 THEN 77 ELSE value END AS value FROM sparse)"


@query(f", {MOSTLY}, d AS (SELECT *, 77::BIGINT AS dominant FROM mostly) {sparse_sql('d')}")
def sparse_num_auto(s, d):
    return N.sparse_auto(streams.clicks(s, d).withColumn("value", F.when(F.col("value") == 0, 77).otherwise(F.col("value"))))


RUNS = f"""runs AS (SELECT {K}, value, min(pos) AS start, count(*) AS length FROM (SELECT *, sum(c) OVER ({W}) AS run FROM (SELECT *, (value IS DISTINCT FROM lag(value) OVER ({W}))::INT AS c FROM prio)) GROUP BY {K}, value, run)"""


@query(f", {RUNS} SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY start) - 1 AS n, start, value, length FROM runs")
def run_length(s, d):
    return N.run_lengths(streams.priority(s, d))


@query(f"SELECT {K}, pos, value FROM prio")
def run_length_decode(s, d):
    return N.undo_run_lengths(N.run_lengths(streams.priority(s, d)))


RISING = f"rising AS (SELECT {K}, pos, (pos % 40) * 3 + (pos // 40) % 5 AS value FROM price)"


@query(f", {RISING}, r AS (SELECT {K}, value, sum(coalesce((value <= lv)::INT, 0)) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(value) OVER ({W}) AS lv FROM rising)) SELECT {K}, value, bit_or(1::BIGINT << run::INT) AS members FROM r GROUP BY {K}, value")
def merge_sorted(s, d):
    return N.merge_sorted(streams.price(s, d).withColumn("value", F.expr("(pos % 40) * 3 + (pos div 40) % 5")))


@query(f"SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY value) - 1 AS token, value FROM (SELECT DISTINCT {K}, value FROM usr)")
def tokenize_alphabet(s, d):
    return N.tokenize(streams.user(s, d))[0]


@query(f"SELECT {K}, pos, dense_rank() OVER (PARTITION BY {K} ORDER BY value) - 1 AS value FROM usr")
def tokenize_numeric_sorted(s, d):
    return N.tokenize(streams.user(s, d))[1]


@query(f", f AS (SELECT {K}, value, row_number() OVER (PARTITION BY {K} ORDER BY min(pos)) - 1 AS token FROM usr GROUP BY {K}, value) SELECT {K}, pos, token AS value FROM usr JOIN f USING ({K}, value)")
def tokenize_numeric(s, d):
    return N.tokenize(streams.user(s, d), in_order=False)[1]


@query(f", f AS (SELECT {K}, value, row_number() OVER (PARTITION BY {K} ORDER BY min(pos)) - 1 AS token FROM etype GROUP BY {K}, value) SELECT {K}, pos, token AS value FROM etype JOIN f USING ({K}, value)")
def tokenize_string(s, d):
    return N.tokenize(streams.event_type(s, d), in_order=False)[1]


@query(f"SELECT {K}, pos, dense_rank() OVER (PARTITION BY {K} ORDER BY value) - 1 AS value FROM etype")
def tokenize_string_sorted(s, d):
    return N.tokenize(streams.event_type(s, d))[1]


@query(f"SELECT {K}, pos, value FROM etype")
def tokenize_decode(s, d):
    return N.undo_tokenize(*N.tokenize(streams.event_type(s, d)))


BOTH = "two AS (SELECT chunk_id, 0 AS input_no, pos, value FROM price UNION ALL SELECT chunk_id, 1, pos, value FROM days)"


@query(f", {BOTH} SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY input_no, pos) - 1 AS pos, value FROM two")
def concat_num(s, d):
    return N.concat([streams.price(s, d), streams.order_day(s, d)])[0]


@query(f", {BOTH} SELECT chunk_id, input_no, count(*) AS size FROM two GROUP BY ALL")
def concat_sizes(s, d):
    return N.concat([streams.price(s, d), streams.order_day(s, d)])[1]


@query("SELECT chunk_id, pos * 2 AS pos, value FROM prio UNION ALL SELECT chunk_id, pos * 2 + 1, value || '!' FROM prio")
def interleave_string(s, d):
    rows = streams.priority(s, d)
    return N.interleave([rows, rows.withColumn("value", F.concat("value", F.lit("!")))])


@query("SELECT chunk_id, pos, value FROM price")
def dedup_num(s, d):
    return N.dedup([streams.price(s, d), streams.price(s, d)])


@query("SELECT chunk_id, pos, value FROM price")
def dedup_num_trusted(s, d):
    return N.dedup([streams.price(s, d), streams.price(s, d)], trusted=True)


@query(f", c AS (SELECT stream_id, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 5 ELSE value END AS value FROM usr) SELECT {K}, min(value) AS value, count(*) AS count FROM c GROUP BY {K} HAVING count(DISTINCT value) = 1")
def constant(s, d):
    return N.constant(streams.user(s, d).withColumn("value", F.when(F.col("chunk_id") % 2 == 0, 5).otherwise(F.col("value"))))


@query(f"SELECT {K}, CASE WHEN pos < 10 THEN 0 WHEN pos < 110 THEN 1 ELSE 2 END AS segment, CASE WHEN pos < 10 THEN pos WHEN pos < 110 THEN pos - 10 ELSE pos - 110 END AS pos, value FROM price")
def split_n(s, d):
    return N.split_n(streams.price(s, d), [10, 100, 0])


@query(
    f""", v AS (SELECT {K}, pos, value + (pos // 300) * 10000000000 AS value FROM price),
    b AS (SELECT {K}, pos // 32 AS block, min(value) AS low, max(value) AS high FROM v GROUP BY ALL),
    c AS (SELECT {K}, block, coalesce(max(high) OVER back < min(low) OVER ahead OR min(low) OVER back > max(high) OVER ahead, false)::INT AS cut FROM b
      WINDOW back AS (PARTITION BY {K} ORDER BY block ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), ahead AS (PARTITION BY {K} ORDER BY block ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
    SELECT {K}, block, sum(cut) OVER (PARTITION BY {K} ORDER BY block ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM c"""
)
def split_by_range(s, d):
    return N.split_by_range(streams.price(s, d).withColumn("value", F.expr("value + (pos div 300) * 10000000000")))


PAIRS = f"pairs AS (SELECT {K}, pos, value % 23 AS literal, value % 61 + 4 AS match FROM usr)"


def pairs(s, d):
    return streams.user(s, d).select("stream_id", "chunk_id", "pos", (F.col("value") % 23).alias("literal"), (F.col("value") % 61 + 4).alias("match"))


@query(f", {PAIRS} SELECT {K}, pos, least(literal, 15) + (least(match - 4, 15) << 4) AS code, CASE WHEN literal >= 15 THEN literal - 15 END AS literal_over, CASE WHEN match - 4 >= 15 THEN match - 4 - 15 END AS match_over FROM pairs")
def mux_lengths(s, d):
    return N.mux_lengths(pairs(s, d), 4, 4)


@query(f", {PAIRS}, o AS (SELECT {K}, split, sum((literal >= (1 << split) - 1)::BIGINT + (match - 4 >= (1 << (8 - split)) - 1)::BIGINT)::BIGINT AS over FROM pairs, (SELECT unnest(range(9))::INT AS split) GROUP BY ALL) SELECT {K}, split, over FROM o QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY over, split) = 1")
def mux_best_split(s, d):
    return N.best_split(pairs(s, d), 4)


@query(f"SELECT {K}, pos, value % 3 AS tag, row_number() OVER (PARTITION BY {K}, value % 3 ORDER BY pos) - 1 AS out_pos, value FROM usr")
def dispatch_by_tag(s, d):
    return N.dispatch(streams.user(s, d), F.col("value") % 3)


@query(f"SELECT {K}, pos, value FROM usr")
def dispatch_decode(s, d):
    return N.undo_dispatch(*N.dispatched(dispatch_by_tag(s, d)))


@query(f"SELECT {K}, pos * 4 + lane AS pos, (value >> (8 * lane)) & 255 AS value FROM price, (SELECT unnest([0, 1, 2, 3]) AS lane)")
def convert_num_to_bytes_le(s, d):
    return N.little_endian_bytes(streams.price(s, d), 4)


@query(f"SELECT {K}, pos * 4 + lane AS pos, (value >> (8 * (3 - lane))) & 255 AS value FROM price, (SELECT unnest([0, 1, 2, 3]) AS lane)")
def convert_num_to_bytes_be(s, d):
    return N.little_endian_bytes(streams.price(s, d), 4, big=True)


#: whole texts of events, padded with zero bytes to structs of a width
PADDED = "padded AS (SELECT 'props' AS stream_id, chunk_id, rpad(h, (((length(h) + {d} - 1) // {d}) * {d})::INT, '0') AS h FROM props_hex)"
CUT = "cut AS (SELECT stream_id, chunk_id, i AS pos, substr(h, ({d} * i + 1)::INT, {d}) AS v FROM (SELECT *, unnest(range(length(h) // {d})) AS i FROM padded))"


def cut(width):
    return f", {PADDED}, {CUT}".replace("{d}", str(2 * width))


def contents(s, d, width):
    size = F.octet_length("props")
    padded = F.rpad(F.hex(F.encode("props", "UTF-8")), F.expr(f"cast(ceil(octet_length(props) / {width}.0) as int) * {2 * width}"), "0")
    return streams.table(s, d, "events").where(size > 0).select(F.lit("props").alias("stream_id"), F.col("event_id").alias("chunk_id"), F.unhex(padded).alias("content"))


def hexed(df):
    return df.withColumn("value", F.hex("value"))


for _w in (1, 2, 4, 8):
    for _big in (False, True):

        def _f(s, d, w=_w, big=_big):
            numbers = T.to_numbers(T.from_serial(contents(s, d, w), w), w, big)
            return numbers.withColumn("value", F.col("value").cast("long"))

        _shift = f"8 * ({_w} - 1 - pos % {_w})" if _big else f"8 * (pos % {_w})"
        query(f"SELECT {K}, pos // {_w} AS pos, sum(value::BIGINT << ({_shift})::INT)::BIGINT AS value FROM bytes GROUP BY {K}, pos // {_w}", f"convert_bytes_to_num_{'be' if _big else 'le'}{8 * _w}")(_f)

for _w in (2, 3, 4, 8):

    def _f(s, d, w=_w):
        return hexed(T.from_serial(contents(s, d, w), w))

    query(f"{cut(_w)} SELECT {K}, pos, v AS value FROM cut", f"convert_serial_to_struct{_w}")(_f)


@query(f"{cut(4)} SELECT {K}, h AS content FROM padded")
def convert_struct_to_serial(s, d):
    return T.to_serial(T.from_serial(contents(s, d, 4), 4)).withColumn("content", F.hex("content"))


@query(f"SELECT {K}, pos, format('{{:08X}}', ((value & 255) << 24) + (((value >> 8) & 255) << 16) + (((value >> 16) & 255) << 8) + ((value >> 24) & 255)) AS value FROM price")
def convert_num_to_struct_le(s, d):
    return hexed(T.from_numbers(streams.price(s, d), 4))


@query(f"SELECT {K}, pos, value FROM price")
def convert_num_to_struct_round_trip(s, d):
    return T.to_numbers(T.from_numbers(streams.price(s, d), 5), 5)


@query(f"{cut(8)}, f AS (SELECT unnest([0, 1, 2])::INT AS field, unnest([1, 3, 7]) AS a, unnest([2, 4, 10]) AS n) SELECT {K}, pos, field, substr(v, a, n) AS value FROM cut, f")
def split_by_struct(s, d):
    return hexed(T.split_fields(T.from_serial(contents(s, d, 8), 8), [1, 2, 5]))


@query(f"{cut(8)} SELECT {K}, pos, v AS value FROM cut")
def split_by_struct_decode(s, d):
    return hexed(T.join_fields(T.split_fields(T.from_serial(contents(s, d, 8), 8), [1, 2, 5])))


@query(f"SELECT {K}, pos, value FROM usr")
def bit_pack_round_trip(s, d):
    return N.bit_unpack(N.bit_pack(streams.user(s, d)))


@query(
    f""", m AS (SELECT {K}, length(bin(max(value))) AS bits, count(*) AS count FROM usr GROUP BY {K}),
    t AS (SELECT {K}, bits, count, string_agg(lpad(bin(value), bits::INT, '0'), '' ORDER BY pos DESC) AS t FROM usr JOIN m USING ({K}) GROUP BY ALL),
    p AS (SELECT *, lpad(t, ((length(t) + 7) // 8 * 8)::INT, '0') AS b, (length(t) + 7) // 8 AS size FROM t)
    SELECT {K}, bits, count, array_to_string(list_transform(range(size), lambda i: format('{{:02X}}', list_reduce(list_transform(range(8), lambda j: ascii(substr(b, ((size - 1 - i) * 8 + j + 1)::INT, 1)) - 48), lambda x, y: x * 2 + y))), '') AS packed_hex FROM p"""
)
def bit_pack(s, d):
    return N.bit_pack(streams.user(s, d)).select("stream_id", "chunk_id", "bits", "count", F.upper("packed_hex").alias("packed_hex"))


@query(
    f""", l AS (SELECT *, lag(value) OVER ({W}) AS b FROM pname),
    n AS (SELECT {K}, pos, value, coalesce((SELECT max(i) FROM (SELECT unnest(range(1, least(length(value), length(b)) + 1)) AS i) WHERE left(value, i) = left(b, i)), 0) AS shared FROM l)
    SELECT {K}, pos, shared, substr(value, shared + 1) AS suffix FROM n"""
)
def prefix(s, d):
    return S.prefix(streams.part_names(s, d))


@query(f"SELECT {K}, pos, value FROM pname")
def prefix_decode(s, d):
    return S.undo_prefix(S.prefix(streams.part_names(s, d)))


@query(f"SELECT {K}, pos, value FROM usr")
def parse_int(s, d):
    return S.parse_int(streams.user(s, d).withColumn("value", F.col("value").cast("string")))


ODD = f"odd AS (SELECT {K}, pos, CASE WHEN value % 4 = 0 THEN '0' || value WHEN value % 4 = 1 THEN '-' || (value + 1) WHEN value % 4 = 2 THEN value || 'x' ELSE value::VARCHAR END AS value FROM usr)"


@query(f", {ODD}, p AS (SELECT *, CASE WHEN regexp_full_match(value, '0|-?[1-9][0-9]*') THEN try_cast(value AS BIGINT) END AS number FROM odd) SELECT {K}, pos, number, CASE WHEN number IS NULL THEN value END AS exception, row_number() OVER (PARTITION BY {K}, number IS NULL ORDER BY pos) - 1 AS out_pos FROM p")
def try_parse_int(s, d):
    v = F.col("value")
    odd = F.when(v % 4 == 0, F.concat(F.lit("0"), v)).when(v % 4 == 1, F.concat(F.lit("-"), v + 1)).when(v % 4 == 2, F.concat(v, F.lit("x"))).otherwise(v.cast("string"))
    return S.try_parse_int(streams.user(s, d).withColumn("value", odd))


@query(f"SELECT {K}, string_agg(value, '' ORDER BY pos) AS content FROM etype GROUP BY {K}")
def separate_strings(s, d):
    return S.separate(streams.event_type(s, d)).drop("lengths")


@query(f"SELECT {K}, pos, value FROM etype")
def set_string_lengths(s, d):
    return S.set_lengths(S.separate(streams.event_type(s, d)))


@query(f"SELECT {K}, pos, length(value) % 3 AS output, row_number() OVER (PARTITION BY {K}, length(value) % 3 ORDER BY pos) - 1 AS out_pos, value FROM etype")
def dispatch_string(s, d):
    return S.string_dispatch(streams.event_type(s, d), F.length("value") % 3)


# -- profiles --


@query(f"SELECT {K}, min(value) AS low, max(value) AS high, max(value) - min(value) AS range_size FROM price GROUP BY {K}")
def profile_range(s, d):
    return P.value_range(streams.price(s, d))


MOMENTS = "m AS (SELECT *, avg(value) OVER (PARTITION BY stream_id, chunk_id) AS mu FROM price)"
SKEW = "round((sum(pow(value - mu, 3)) / count(*)) / pow(sum(pow(value - mu, 2)) / count(*), 1.5), 4)"
KURT = "round((sum(pow(value - mu, 4)) / count(*)) / pow(sum(pow(value - mu, 2)) / count(*), 2) - 3, 4)"


@query(f", {MOMENTS} SELECT {K}, count(*) AS n, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 4) AS stddev, {SKEW} AS skewness, {KURT} AS kurtosis FROM m GROUP BY {K}")
def profile_moments(s, d):
    return P.moments(streams.price(s, d))


@query(f", {MOMENTS} SELECT {K}, count(*) AS n, 8 AS elt_width, count(DISTINCT value) AS cardinality, max(value) - min(value) AS range_size, round(avg(value), 4) AS mean, round(var_samp(value), 4) AS variance, {SKEW} AS skewness, {KURT} AS kurtosis FROM m GROUP BY {K}")
def profile_features(s, d):
    return P.features(streams.price(s, d))


@query(f"SELECT {K}, count(DISTINCT value) AS cardinality FROM usr GROUP BY {K}")
def profile_cardinality(s, d):
    return P.cardinality(streams.user(s, d))


@query()
def profile_cardinality_approximate(s, d):
    return P.approximate_cardinality(streams.user(s, d))


@query()
def profile_linear_counting(s, d):
    return P.linear_counting_error(streams.user(s, d))


@query(f"SELECT {K}, value, count(*) AS count FROM bytes GROUP BY ALL")
def byte_histogram(s, d):
    return P.histogram(streams.text_bytes(s, d))


DELTAS = f"deltas AS (SELECT {K}, pos, (value - lag(value) OVER ({W}) + 256) % 256 AS value FROM bytes)"


@query(f", {DELTAS} SELECT {K}, value, count(*) AS count FROM deltas WHERE value IS NOT NULL GROUP BY ALL")
def delta_histogram(s, d):
    return P.histogram(P.byte_deltas(streams.text_bytes(s, d)))


def entropy_sql(source: str) -> str:
    return f"e AS (SELECT {K}, sum(c)::BIGINT AS n, count(*) AS cardinality, max(value) AS top, abs(round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6)) AS entropy FROM (SELECT {K}, value, count(*) AS c FROM {source} WHERE value IS NOT NULL GROUP BY ALL) GROUP BY {K})"


@query(f", {entropy_sql('bytes')} SELECT * FROM e")
def byte_entropy(s, d):
    return P.entropy(streams.text_bytes(s, d))


@query(f", {DELTAS}, {entropy_sql('deltas')} SELECT * FROM e")
def delta_entropy(s, d):
    return P.entropy(P.byte_deltas(streams.text_bytes(s, d)))


SIZES = f"""{entropy_sql("bytes")}, s AS (SELECT {K}, n, cardinality, top, entropy, n AS store, ceil(n * length(bin(top)) / 8.0)::BIGINT AS bitpack,
 CASE WHEN cardinality <= 128 THEN ceil(n * greatest(length(bin(cardinality - 1)), 1) / 8.0) + cardinality END::BIGINT AS flatpack,
 CASE WHEN cardinality = 1 THEN 1 + ceil(length(bin(n)) / 7.0) END::BIGINT AS constant,
 (9 + ceil(least(5 * cardinality, 4 * (top + 1)) / 8.0) + floor(greatest(entropy, 1) * n / 8))::BIGINT AS huffman FROM e)"""


@query(f", {SIZES} SELECT * FROM s")
def encoding_sizes(s, d):
    return P.sizes(streams.text_bytes(s, d))


@query(f", l AS (SELECT {K}, k AS stride, value, lag(value, k::INT) OVER (PARTITION BY {K}, k ORDER BY pos) AS b FROM bytes, (SELECT unnest([1, 2, 3, 4, 8, 16]) AS k)) SELECT {K}, stride, coalesce(sum((value = b)::BIGINT), 0)::BIGINT AS matches FROM l GROUP BY ALL")
def dimensionality(s, d):
    return P.stride_matches(streams.text_bytes(s, d))


@query(f", l AS (SELECT {K}, w AS width, pos % w AS lane, value, count(*) AS c FROM bytes, (SELECT unnest([1, 2, 4, 8]) AS w) GROUP BY ALL), e AS (SELECT {K}, width, lane, sum(c) * log2(sum(c)) - sum(c * log2(c)) AS b FROM l GROUP BY ALL), t AS (SELECT {K}, width, round(sum(b), 4) AS bits FROM e GROUP BY ALL) SELECT {K}, width, bits FROM t QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY bits, width) = 1")
def guess_float_width(s, d):
    return P.guess_width(streams.text_bytes(s, d))


@query(f"SELECT {K}, sum(value)::BIGINT AS total, max(value) AS top, bool_and(value < 1000) AS all_below, CASE WHEN max(value) < 256 THEN 1 WHEN max(value) < 65536 THEN 2 WHEN max(value) < 4294967296 THEN 4 ELSE 8 END AS width FROM usr GROUP BY {K}")
def reductions(s, d):
    return P.reductions(streams.user(s, d), 1000)


@query("WITH t AS (SELECT event_id, props FROM events) SELECT event_id, md5(props) AS md5, sha1(props) AS sha1, sha256(props) AS sha256 FROM t")
def checksums(s, d):
    return P.checksums(streams.table(s, d, "events"), "event_id", "props").drop("crc32")
