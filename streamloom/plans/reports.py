"""Queries of codecs, plan choice, catalogues, records, block transforms and windowed profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamloom.functions import blocks, chunking, codecs, custom, graphs, records
from streamloom.operators import catalogue as C
from streamloom.operators import numeric as N
from streamloom.operators import profile as P
from streamloom.plans import choose
from streamloom.plans.encodings import SIZES, STREAMS
from streamloom.sources import store, streams
from streamloom.streaming import profiles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# -- codecs --


def cell(x) -> str:
    if x is None or isinstance(x, (bool, int)):
        return "NULL" if x is None else str(x).lower()
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


REGISTERED = [line.split(";") for line in codecs.REGISTRY.strip().split("\n")]
AVAILABLE = set(codecs.bindings())


@query(f"SELECT * FROM (VALUES {values([(n, v, int(a), int(b), int(p), t, n in AVAILABLE) for n, v, a, b, p, t in REGISTERED])}) AS t(name, version, first_level, last_level, param, mt_mode, available)")
def codec_registry(s, d):
    return codecs.registry(s)


@query(f"SELECT * FROM (VALUES {values([('memcpy', 0, 0), ('bzip2', 1, 1), ('bzip2', 9, 2), ('zlib', 2, 3), ('zlib', 3, 4), ('zlib', 4, 5), ('lzo1', 1, 6), ('lzo1', 99, 7)])}) AS t(codec, level, job_no)")
def codec_jobs(s, d):
    return codecs.jobs(s, "memcpy/bzip2,1,9/zlib,2-4/lzo1")


def blobs(s, d):
    return streams.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))


LIST = "memcpy/zlib,1,6/bzip2,9/lzma,0/xz,1/zstd,1,3/zstd_fast,-3/zstdLDM,2/zstd22,16/zstd22LDM,16/zstd24,16/zstd24LDM,16/snappy/lz4/lz4hc,3,9/brotli,2"
PAIRS = [x for x in codecs.expand(LIST) if x[0] in AVAILABLE]


@query(f"SELECT codec, level, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS origsize, true AS restored FROM documents, (VALUES {values(PAIRS)}) AS j(codec, level) GROUP BY ALL")
def codec_round_trip(s, d):
    return codecs.summarize(codecs.run(blobs(s, d), LIST)).select("codec", "level", "origsize", "restored")


@query()
def codec_pareto(s, d):
    out = codecs.summarize(codecs.run(blobs(s, d), LIST), "median")
    return P.pareto(out.select(F.concat_ws(" -", "codec", "level").alias("algname"), "comprsize", "cspeed"), "algname", "comprsize", "cspeed")


#: a measured table as it would be read from disk, for the operators on results
MEASURED = "SELECT o_orderpriority || '/' || o_orderstatus AS algname, sum(o_orderkey)::BIGINT AS ctime, count(*) AS dtime, sum(o_orderkey % 1000)::BIGINT AS comprsize, sum(o_orderkey % 3000)::BIGINT AS origsize FROM orders GROUP BY 1"


def measured(s, d):
    k = F.col("o_orderkey")
    return streams.table(s, d, "orders").groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("algname")).agg(F.sum(k).alias("ctime"), F.count("*").alias("dtime"), F.sum(k % 1000).alias("comprsize"), F.sum(k % 3000).alias("origsize"))


for _i, _by in enumerate(["algname", "ctime DESC, algname", "dtime DESC, algname", "comprsize, algname", "origsize, algname"], 1):

    def _sorted(s, d, column=_i):
        return codecs.ranked(measured(s, d), column)

    QUERIES[f"results_sort_{_i}"] = _sorted
    SQL[f"results_sort_{_i}"] = f"SELECT row_number() OVER (ORDER BY {_by}) AS place, * FROM ({MEASURED})"


@query(f"SELECT algname, comprsize, dtime FROM ({MEASURED}) a WHERE NOT EXISTS (SELECT 1 FROM ({MEASURED}) b WHERE b.algname <> a.algname AND b.comprsize <= a.comprsize AND b.dtime >= a.dtime AND (b.comprsize < a.comprsize OR b.dtime > a.dtime OR b.algname < a.algname))")
def results_pareto(s, d):
    return P.pareto(measured(s, d).select("algname", "comprsize", "dtime"), "algname", "comprsize", "dtime")


@query(f"SELECT format('{{}},{{}},{{}},{{}},{{}}', algname, ctime, dtime, comprsize, origsize) AS line FROM ({MEASURED})")
def results_csv(s, d):
    return codecs.rendered(measured(s, d), "csv")


@query(f"SELECT format('| {{}} | {{}} | {{}} | {{}} | {{}} |', algname, ctime, dtime, comprsize, origsize) AS line FROM ({MEASURED})")
def results_markdown(s, d):
    return codecs.rendered(measured(s, d), "markdown")


TIMES = "SELECT event_type AS codec, user_id % 3 AS level, user_id % 50 AS id, event_id AS ns FROM events"


@query(f"SELECT codec, level, min(ns) AS fastest, round(avg(ns), 4) AS average, median(ns) AS middle FROM ({TIMES}) GROUP BY ALL")
def measure_aggregate(s, d):
    rows = streams.table(s, d, "events").select(F.col("event_type").alias("codec"), (F.col("user_id") % 3).alias("level"), F.col("event_id").alias("ns"))
    return rows.groupBy("codec", "level").agg(F.min("ns").alias("fastest"), F.round(F.avg("ns"), 4).alias("average"), F.median("ns").alias("middle"))


# -- sources --


@query("SELECT doc_id AS id, c AS chunk_id, least(500, n - c * 500)::INT AS size FROM (SELECT doc_id, n, unnest(range(greatest((n + 499) // 500, 1))) AS c FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents))")
def serial_blocks(s, d):
    return streams.blocks(blobs(s, d), "id", "bytes", 500).select("id", "chunk_id", F.octet_length("bytes").alias("size"))


@query("SELECT doc_id AS id, c AS chunk_id, least(500, n - c * 500)::INT AS size FROM (SELECT doc_id, n, unnest(range(greatest((n + 499) // 500, 1))) AS c FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents))")
def numeric_blocks(s, d):
    return streams.blocks(blobs(s, d), "id", "bytes", 503, align=4).select("id", "chunk_id", F.octet_length("bytes").alias("size"))


@query("SELECT doc_id AS id, substr(hex(encode(coalesce(text, ''))), 1401, 2400) AS bytes_hex FROM documents")
def store_range(s, d):
    return store.read(store.pack(blobs(s, d), size=500), start=700, length=1200).select("id", F.hex("bytes").alias("bytes_hex"))


@query("SELECT doc_id AS id, md5(coalesce(text, '')) AS digest FROM documents")
def store_whole(s, d):
    return store.read(store.pack(blobs(s, d), "xz", 1, size=4096, max_input=1500), "xz").select("id", F.md5("bytes").alias("digest"))


@query("SELECT doc_id AS id, n AS size, greatest((n + 499) // 500, 1) AS chunks FROM (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents)")
def store_list(s, d):
    return store.listed(store.pack(blobs(s, d), size=500))


@query("SELECT doc_id AS id, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS start, n AS size FROM (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents)")
def store_joined(s, d):
    return store.joined(blobs(s, d), 64)


@query("SELECT doc_id AS id, n + n // 8 + 1024 AS most, true AS within FROM (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents)")
def store_bound(s, d):
    made = store.pack(blobs(s, d), "lz4", 1, size=1 << 26)
    return made.select("id", store.bound(F.col("size")).alias("most"), (F.octet_length("stored") <= store.bound(F.col("size"))).alias("within"))


# -- bytes in reverse --

for _bits in (16, 32, 64):
    _sum = " + ".join(f"(((value >> {8 * i}) & 255)::HUGEINT << {_bits - 8 - 8 * i})" for i in range(_bits // 8))

    def _swapped(s, d, bits=_bits):
        return N.byteswap(streams.price(s, d), bits)

    QUERIES[f"byteswap_{_bits}"] = _swapped
    SQL[f"byteswap_{_bits}"] = f"WITH {STREAMS} SELECT stream_id, chunk_id, pos, (CASE WHEN x >= 9223372036854775808::HUGEINT THEN x - 18446744073709551616::HUGEINT ELSE x END)::BIGINT AS value FROM (SELECT *, {_sum} AS x FROM price)"


# -- choice of plans --


@query(
    f"""WITH {STREAMS}, {SIZES}, c AS (SELECT *, CASE WHEN n > 64 AND huffman + greatest(32, ceil(n / 100.0)) <= n THEN huffman END AS e, CASE WHEN flatpack < bitpack AND flatpack < n THEN flatpack END AS f, CASE WHEN bitpack < n THEN bitpack END AS b FROM s),
    m AS (SELECT *, least(e, f, b, n) AS cost0 FROM c)
    SELECT stream_id, chunk_id, n, CASE WHEN n <= 1 THEN 'store' WHEN cardinality = 1 THEN 'constant' WHEN f = cost0 THEN 'flatpack' WHEN b = cost0 THEN 'bitpack' WHEN e = cost0 THEN 'huffman' ELSE 'store' END AS choice,
    CASE WHEN cardinality = 1 THEN least(constant, n) ELSE cost0 END::BIGINT AS cost FROM m"""
)
def plan_entropy_choice(s, d):
    return choose.entropy_choice(P.sizes(streams.text_bytes(s, d)))


@query(f"WITH {STREAMS}, {SIZES}, c AS (SELECT stream_id, chunk_id, unnest([0, 1, 2]) AS i, unnest(['store', 'bitpack', 'flatpack']) AS candidate, unnest([store, bitpack, flatpack]) AS size FROM s) SELECT stream_id, chunk_id, candidate, size FROM c QUALIFY row_number() OVER (PARTITION BY stream_id, chunk_id ORDER BY size NULLS LAST, i) = 1")
def plan_brute_force(s, d):
    z = P.sizes(streams.text_bytes(s, d))
    options = F.array(*[F.struct(F.lit(i).alias("candidate_no"), F.lit(n).alias("candidate"), F.col(n).alias("size")) for i, n in enumerate(["store", "bitpack", "flatpack"])])
    return choose.brute_force(z.select("stream_id", "chunk_id", F.explode(options).alias("o")).select("stream_id", "chunk_id", "o.*"))


@query(f"WITH {STREAMS}, {SIZES}, c AS (SELECT stream_id, chunk_id, unnest([0, 1, 2, 3, 4]) AS i, unnest(['store', 'bitpack', 'flatpack', 'huffman', 'constant']) AS candidate, unnest([store, bitpack, flatpack, CASE WHEN n > 64 THEN huffman + greatest(32, ceil(n / 100.0)) END, CASE WHEN cardinality = 1 THEN constant END])::BIGINT AS size FROM s) SELECT stream_id, chunk_id, candidate, size FROM c QUALIFY row_number() OVER (PARTITION BY stream_id, chunk_id ORDER BY size NULLS LAST, i) = 1")
def plan_entropy_choice_old_format(s, d):
    z = P.sizes(streams.text_bytes(s, d))
    sizes = {"store": F.col("store"), "bitpack": F.col("bitpack"), "flatpack": F.col("flatpack"), "huffman": F.when(F.col("n") > 64, F.col("huffman") + F.greatest(F.lit(32), F.ceil(F.col("n") / 100))), "constant": F.when(F.col("cardinality") == 1, F.col("constant"))}
    options = F.array(*[F.struct(F.lit(i).alias("candidate_no"), F.lit(n).alias("candidate"), x.cast("long").alias("size")) for i, (n, x) in enumerate(sizes.items())])
    return choose.brute_force(z.select("stream_id", "chunk_id", F.explode(options).alias("o")).select("stream_id", "chunk_id", "o.*"))


@query(
    """WITH v AS (SELECT 'customers' AS stream_id, o_orderkey // 1024 AS chunk_id, (o_custkey % CASE WHEN o_orderkey // 1024 % 3 = 0 THEN 40 ELSE 60000 END) * CASE WHEN o_orderkey // 1024 % 3 = 0 THEN 997 ELSE 1 END AS value FROM orders),
    c AS (SELECT stream_id, chunk_id, value, count(*) AS c FROM v GROUP BY ALL), s AS (SELECT stream_id, chunk_id, sum(c)::BIGINT AS n, count(*) AS cardinality, max(value) AS top, sum(c * log2(c)) AS clog FROM c GROUP BY ALL),
    e AS (SELECT *, round(log2(n) - clog / n, 9) AS entropy, 2 * n AS store, ceil(n * greatest(floor(log2(greatest(top, 1))) + 1, 1) / 8) AS bitpack FROM s), h AS (SELECT *, ceil(greatest(1.0, entropy) * n / 8) + greatest(100, top // 4) AS huffman FROM e)
    SELECT stream_id, chunk_id, n, cardinality, CASE WHEN cardinality = 1 THEN 'constant' WHEN bitpack <= huffman AND bitpack < store THEN 'bitpack' WHEN entropy > 15 OR huffman >= store THEN 'store' WHEN cardinality < 256 THEN 'tokenize_huffman' ELSE 'huffman_struct' END AS choice FROM h"""
)
def plan_two_byte_choice(s, d):
    part = F.expr("o_orderkey div 1024")
    few = part % 3 == 0
    rows = streams.table(s, d, "orders").select(F.lit("customers").alias("stream_id"), part.alias("chunk_id"), (F.col("o_custkey") % F.when(few, 40).otherwise(60000) * F.when(few, 997).otherwise(1)).alias("value"))
    return choose.two_byte_choice(rows)


@query()
def plan_context_clusters(s, d):
    """Types of events by the user's last digit: digits whose types are spread alike share a code."""
    e = streams.table(s, d, "events").select(F.lit("types").alias("stream_id"), (F.col("user_id") % 10).alias("context"), F.ascii("event_type").alias("symbol"))
    return choose.merged_contexts(e.groupBy("stream_id", "context", "symbol").agg(F.count("*").alias("n")))


@query(f"WITH {STREAMS} SELECT 'price' AS stream_id, 'numeric' AS type, 8 AS elt_width, count(DISTINCT chunk_id) AS chunks, count(*) AS elements, 'field_lz' AS graph FROM price UNION ALL SELECT 'event_type', 'string', 0, count(DISTINCT chunk_id), count(*), 'separate_zstd' FROM etype")
def plan_by_type(s, d):
    return choose.by_type(streams.catalog_of(streams.price(s, d), "numeric", 8).unionByName(streams.catalog_of(streams.event_type(s, d), "string", 0)))


INPUTS = "SELECT event_id AS input_no, user_id % 7 AS tag, 'numeric' AS type, 4 AS width FROM events"


@query(f"SELECT input_no, tag, type, width, CASE tag WHEN 1 THEN 'a' WHEN 2 THEN 'a' WHEN 3 THEN 'b' ELSE 'tag-' || tag || '-' || type || '-' || width END AS cluster FROM ({INPUTS})")
def plan_clusters(s, d):
    rows = streams.table(s, d, "events").select(F.col("event_id").alias("input_no"), (F.col("user_id") % 7).alias("tag"), F.lit("numeric").alias("type"), F.lit(4).alias("width"))
    config = s.createDataFrame([(1, "numeric", 4, "a"), (2, "numeric", 4, "a"), (3, "numeric", 4, "b")], "tag long, type string, width int, cluster string")
    return choose.cluster(rows, config)


# -- catalogues --

HISTORY = "SELECT o_custkey::VARCHAR AS name, o_orderkey AS version, md5(o_orderpriority) AS hash, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 97 END AS size, o_orderkey % 11 = 0 AS deleted FROM orders"
LATEST = "SELECT * FROM ({}) QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC) = 1"


def history(s, d):
    k = F.col("o_orderkey")
    return streams.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("name"), k.alias("version"), F.md5("o_orderpriority").alias("hash"), F.when(k % 11 == 0, 0).otherwise(k % 97).alias("size"), (k % 11 == 0).alias("deleted"))


@query(f"SELECT * FROM ({LATEST.format(HISTORY)}) WHERE NOT deleted")
def catalogue_latest(s, d):
    return C.latest(history(s, d))


@query(f"SELECT * FROM ({LATEST.format(f'SELECT * FROM ({HISTORY}) WHERE version <= 5000')}) WHERE NOT deleted")
def catalogue_as_of(s, d):
    return C.latest(C.as_of(history(s, d), 5000))


@query(f"SELECT * FROM ({HISTORY}) WHERE version <= (SELECT max(o_orderkey) FROM orders) - 100")
def catalogue_as_of_from_end(s, d):
    return C.as_of(history(s, d), -100)


@query(f"SELECT version, sum((NOT deleted)::BIGINT)::BIGINT AS updates, sum(deleted::BIGINT)::BIGINT AS deletions, sum(size)::BIGINT AS bytes FROM ({HISTORY}) GROUP BY 1")
def catalogue_versions(s, d):
    return C.versions(history(s, d))


SIDES = f"WITH a AS ({LATEST.format(f'SELECT * FROM ({HISTORY}) WHERE version <= 6000')}), b AS ({LATEST.format(f'SELECT * FROM ({HISTORY}) WHERE version > 4000')})"
MARKS = "SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN '-' WHEN a.name IS NULL THEN '+' WHEN a.hash = b.hash AND a.size = b.size THEN '=' ELSE '#' END AS mark FROM (SELECT * FROM a WHERE NOT deleted) a FULL JOIN (SELECT * FROM b WHERE NOT deleted) b ON a.name = b.name"


def sides(s, d):
    h = history(s, d)
    return C.latest(h.where("version <= 6000")), C.latest(h.where("version > 4000"))


@query(f"{SIDES} {MARKS}")
def catalogue_compare(s, d):
    return C.compare(*sides(s, d))


@query(f"{SIDES} SELECT * FROM ({MARKS}) WHERE mark <> '='")
def catalogue_changes(s, d):
    return C.changes(*sides(s, d))


@query(f"SELECT * FROM ({LATEST.format(HISTORY)}) WHERE NOT deleted AND (name LIKE '1%' OR name LIKE '_5') AND name NOT LIKE '%7'")
def catalogue_select(s, d):
    return C.select(C.latest(history(s, d)), ["1*", "?5"], ["*7"])


@query(f"SELECT CASE WHEN name LIKE '1%' THEN 'one/' || substr(name, 2) ELSE name END AS name, version, hash, size, deleted FROM ({LATEST.format(HISTORY)}) WHERE NOT deleted")
def catalogue_rename(s, d):
    return C.rename(C.latest(history(s, d)), [("1", "one/")])


@query(f"SELECT name, size, hash, CASE WHEN lag(hash) OVER (ORDER BY size DESC, hash, name) = hash THEN '^' ELSE '' END AS mark FROM (SELECT * FROM ({LATEST.format(HISTORY)}) WHERE NOT deleted ORDER BY size DESC, hash, name LIMIT 20)")
def catalogue_largest(s, d):
    return C.largest(C.latest(history(s, d)), 20)


@query()
def fragments_first_copies(s, d):
    return C.first_copies(chunking.fragments(streams.table(s, d, "documents"), "doc_id", "text", 256))


@query("SELECT doc_id::VARCHAR AS name, octet_length(encode(text))::BIGINT AS size FROM documents WHERE length(text) > 0")
def fragments_cover(s, d):
    return chunking.fragments(streams.table(s, d, "documents"), "doc_id", "text", 256).groupBy("name").agg(F.sum("size").alias("size"))


# -- records --

#: two numbers of two bytes, then a structure of a byte and three characters as often as it fits, then the rest
PROGRAM = """
push.tag 1
push.type.u16le
push.u32 2
segment.create_tagged
push.tag 2
push.type.u8
push.type.bytes
push.u32 3
type.fixed_array
push.u32 2
type.structure
push.remaining
push.u32 4
math.div
segment.create_tagged
push.remaining
segment.create_unspecified
"""
PROPS = "SELECT event_id AS id, octet_length(encode(props)) AS n FROM events"


@query(
    f"""WITH p AS ({PROPS}), s AS (SELECT id, 0 AS segment_no, 1 AS tag, 'u16le' AS type, 0 AS start, 4 AS size FROM p WHERE n >= 4
    UNION ALL SELECT id, 1, 2, '{{u8,bytes[3]}}', 4, (n - 4) // 4 * 4 FROM p WHERE n >= 4 UNION ALL SELECT id, 2, -1, 'bytes', 4 + (n - 4) // 4 * 4, (n - 4) % 4 FROM p WHERE n >= 4
    UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL FROM p WHERE n < 4)
    SELECT *, CASE WHEN segment_no IS NULL THEN 'a segment ends outside the blob' END AS error FROM s"""
)
def record_segments(s, d):
    return records.segments(streams.table(s, d, "events"), "event_id", "props", PROGRAM)


# -- block transforms --


def props_blocks(s, d):
    return streams.table(s, d, "events").select(F.col("event_id").alias("id"), F.lit(0).cast("long").alias("chunk_id"), F.encode("props", "UTF-8").alias("bytes"))


def part_blocks(s, d):
    """A block for each part: its name, type, key, brand and name again."""
    line = F.concat_ws("/", "p_name", "p_type", F.lpad(F.col("p_partkey").cast("string"), 9, "0"), "p_brand", "p_name")
    return streams.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("chunk_id"), F.encode(line, "UTF-8").alias("bytes"))


#: the same transforms in SQL: from rows (id, i, v), a row for each byte, to such rows
RAW = "SELECT id, i, ('0x' || substr(h, 2 * i + 1, 2))::INT AS v FROM (SELECT id, h, unnest(range(0, length(h) // 2)) AS i FROM (SELECT p_partkey AS id, hex(encode(concat_ws('/', p_name, p_type, lpad(p_partkey::VARCHAR, 9, '0'), p_brand, p_name))) AS h FROM part))"
EACH = "PARTITION BY id ORDER BY i"
COUNTED = "SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ({r})"
WHOLE = "SELECT id, string_agg(printf('%02X', v), '' ORDER BY i) AS h, count(*) AS n FROM ({r}) GROUP BY id"
RUNS = f"SELECT *, sum(e) OVER ({EACH}) AS run FROM (SELECT *, CASE WHEN lag(v) OVER ({EACH}) = v {{same}} THEN 0 ELSE 1 END AS e FROM ({{r}}))"
PAIRS_OF_RUNS = f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY place, k) - 1 AS i, CASE k WHEN 0 THEN v ELSE c - 1 END AS v FROM (SELECT id, min(i) AS place, any_value(v) AS v, count(*) AS c FROM (SELECT *, (i - min(i) OVER (PARTITION BY id, run)) // 256 AS part FROM ({RUNS})) GROUP BY id, run, part), (SELECT unnest([0, 1]) AS k) WHERE k = 0 {{second}}"
LITTLE = "(({x}) >> (8 * {i})) & 255"
#: symbols by falling frequency within a block
RANKED = "SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, v) - 1 AS rank FROM ({r}) GROUP BY id, v"
#: for each byte and each symbol that came before it, the last and the last but one time
BEFORE = "SELECT a.id, a.i, a.v, b.v AS s, max(b.i) AS t, coalesce(max(b.i) FILTER (b.i < b.latest), 0) AS u FROM ({r}) a JOIN (SELECT x.*, y.i AS now, max(x.i) OVER (PARTITION BY x.id, y.i, x.v) AS latest FROM ({r}) x JOIN ({r}) y ON x.id = y.id AND x.i < y.i) b ON a.id = b.id AND a.i = b.now GROUP BY ALL"
TRANSFORMED = {
    "transpose": f"SELECT id, CASE WHEN i < n // 4 * 4 THEN i % 4 * (n // 4) + i // 4 ELSE i END AS i, v FROM ({COUNTED})",
    "mm": f"SELECT id, i, CASE WHEN i >= 4 THEN (v - lag(v, 4) OVER ({EACH}) + 256) % 256 ELSE v END AS v FROM ({{r}})",
    "rlt": PAIRS_OF_RUNS.replace("{same}", "").replace("{second}", "OR true"),
    "zrlt": PAIRS_OF_RUNS.replace("{same}", "AND v = 0").replace("{second}", "OR v = 0"),
    "mtf": f"SELECT id, i, CASE WHEN own IS NULL THEN v + above ELSE since END AS v FROM (SELECT a.id, a.i, a.v, max(t) FILTER (s = a.v) AS own, count(*) FILTER (s > a.v) AS above, count(*) FILTER (t > mine) AS since FROM ({{r}}) a LEFT JOIN (SELECT *, max(t) FILTER (s = v) OVER (PARTITION BY id, i) AS mine FROM ({BEFORE})) b ON a.id = b.id AND a.i = b.i GROUP BY a.id, a.i, a.v)",
    "rank": f"SELECT id, i, CASE WHEN own IS NULL THEN v + above ELSE ahead END AS v FROM (SELECT a.id, a.i, a.v, max(t) FILTER (s = a.v) AS own, count(*) FILTER (s > a.v) AS above, count(*) FILTER (key > my_key OR key = my_key AND t > my_t) AS ahead FROM ({{r}}) a LEFT JOIN (SELECT *, max(key) FILTER (s = v) OVER (PARTITION BY id, i) AS my_key, max(t) FILTER (s = v) OVER (PARTITION BY id, i) AS my_t FROM (SELECT *, (t + u) // 2 AS key FROM ({BEFORE}))) b ON a.id = b.id AND a.i = b.i GROUP BY a.id, a.i, a.v)",
    "srt": f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY c DESC, v) - 1 AS i, v FROM (SELECT k.id, k.v, count(r.i) AS c FROM (SELECT id, unnest(range(0, 256)) AS v FROM (SELECT DISTINCT id FROM ({{r}}))) k LEFT JOIN ({{r}}) r ON r.id = k.id AND r.v = k.v GROUP BY ALL) UNION ALL SELECT r.id, 256 + r.i, k.rank FROM ({{r}}) r JOIN ({RANKED}) k ON r.id = k.id AND r.v = k.v",
    "bwt": f"SELECT id, k AS i, {LITTLE.format(x="origin", i="k")} AS v FROM (SELECT id, place AS origin, unnest([0, 1, 2, 3]) AS k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turned, i) - 1 AS place FROM (SELECT id, i, substr(h, 2 * i + 1) || substr(h, 1, 2 * i) AS turned FROM (SELECT *, unnest(range(0, n)) AS i FROM ({WHOLE})))) WHERE i = 0) UNION ALL SELECT id, 4 + row_number() OVER (PARTITION BY id ORDER BY turned, i) - 1, ('0x' || right(turned, 2))::INT FROM (SELECT id, i, substr(h, 2 * i + 1) || substr(h, 1, 2 * i) AS turned FROM (SELECT *, unnest(range(0, n)) AS i FROM ({WHOLE})))",
    "bwts": f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY repeat(turned, 2 * n)[: 4 * n], i) - 1 AS i, ('0x' || right(turned, 2))::INT AS v FROM (SELECT id, n, i, substr(word, 2 * (i - start) + 1) || substr(word, 1, 2 * (i - start)) AS turned FROM (SELECT *, substr(h, 2 * start + 1, 2 * (finish - start)) AS word FROM (SELECT *, max(CASE WHEN least_before IS NULL OR suffix < least_before THEN i END) OVER ({EACH}) AS start, coalesce(min(CASE WHEN suffix < least_before THEN i END) OVER ({EACH} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS finish FROM (SELECT *, min(suffix) OVER ({EACH} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least_before FROM (SELECT *, substr(h, 2 * i + 1) AS suffix FROM (SELECT *, unnest(range(0, n)) AS i FROM ({WHOLE})))))))",
}


def encoded(names: list[str]) -> str:
    rows = RAW
    for n in names:
        rows = TRANSFORMED[n].replace("{r}", rows)
    return f"SELECT id, string_agg(printf('%02X', v), '' ORDER BY i) AS encoded, true AS restored FROM ({rows}) GROUP BY id"


for _chain in [["bwt"], ["bwts"], ["mtf"], ["rank"], ["rlt"], ["srt"], ["mm"], ["transpose"], ["bwt", "mtf", "zrlt"]]:

    def _block(s, d, names=tuple(_chain)):
        return blocks.apply(part_blocks(s, d), list(names)).select("id", F.hex("bytes").alias("encoded"), "restored")

    _name = f"block_{_chain[0] if len(_chain) == 1 else 'chain'}"
    QUERIES[_name], SQL[_name] = _block, encoded(_chain)

def whole_text(undone):
    """doc_id and the digest of the text whose blocks were undone."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_id", F.hex("bytes").alias("h"))))
    return undone.groupBy("id").agg(F.md5(F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), ""))).alias("digest"))


for _name in ["pack", "zrlt", "lzp", "rolz", "rolzx", "utf", "dna", "exe", "dict", "arm", "arm64", "ppc", "fse", "ans0", "ans1", "range"]:

    def _restored(s, d, name=_name):
        return whole_text(blocks.undo(blocks.apply(streams.blocks(blobs(s, d), "id", "bytes", 1000), [name], verify=False), [name]))

    QUERIES[f"block_{_name}_restored"] = _restored
    SQL[f"block_{_name}_restored"] = "SELECT doc_id AS id, md5(coalesce(text, '')) AS digest FROM documents"

for _name in ["fpaq", "cm", "paq", "tpaq", "tpaqx"]:

    def _mixed(s, d, name=_name):
        return blocks.undo(blocks.apply(part_blocks(s, d), [name], verify=False), [name]).select("id", F.hex("bytes").alias("bytes_hex"))

    QUERIES[f"block_{_name}_restored"] = _mixed
    SQL[f"block_{_name}_restored"] = f"SELECT id, string_agg(printf('%02X', v), '' ORDER BY i) AS bytes_hex FROM ({RAW}) GROUP BY id"


@query("SELECT event_id AS id, octet_length(encode(props))::BIGINT AS n, true AS restored, true AS within_a_bit_of_entropy FROM events")
def block_huffman(s, d):
    return blocks.huffman(props_blocks(s, d)).select("id", "n", "restored", "within_a_bit_of_entropy")


@query()
def block_huffman_size(s, d):
    return blocks.huffman_sizes(props_blocks(s, d))


# -- windows --


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def windowed_profile(s, d):
    return profiles.windowed_profile(streams.table(s, d, "events"), "ts", "value", "event_type")


# -- graphs --


for _name in ["huffman", "delta_huffman", "store", "num8", "num64", "flatpack", "bitpack", "zstd", "lz4", "lz", "delta_zstd", "delta_flatpack", "num16", "num16_delta", "num32_range_pack", "num32_tokenize", "num64_delta", "num64_bitpack", "fse", "field_lz8", "field_lz16", "field_lz32", "field_lz64", "delta32_field_lz", "tokenize16_delta_field_lz", "partition_bitpack32"]:

    def _graph(s, d, name=_name):
        graph = graphs.GRAPHS[name]
        return whole_text(graphs.restored(graphs.stored(streams.blocks(blobs(s, d), "id", "bytes", 1000), graph), graph))

    QUERIES[f"graph_{_name}_restored"] = _graph
    SQL[f"graph_{_name}_restored"] = "SELECT doc_id AS id, md5(coalesce(text, '')) AS digest FROM documents"


@query("SELECT event_id AS id, octet_length(encode(props))::BIGINT AS n, true AS no_larger, true AS restored FROM events")
def graph_brute_force(s, d):
    return graphs.try_all(props_blocks(s, d)).select("id", "n", (F.col("size") <= F.coalesce("n", F.lit(0))).alias("no_larger"), "restored")


@query("SELECT doc_id AS id, true AS restored FROM documents")
def trained_dictionary(s, d):
    return graphs.with_dictionary(blobs(s, d), graphs.train_dictionary(blobs(s, d))).select("id", "restored")


#: a small forest for each label: high cardinality, narrow range, or neither
FORESTS = [[graphs.Tree((0, -1, -1), (100.0, -1.0, 1.0), (1, 0, 0), (2, 0, 0), (1, 0, 0))], [graphs.Tree((1, -1, -1), (5000000.0, 2.0, -2.0), (1, 0, 0), (2, 0, 0), (2, 0, 0))], [graphs.Tree((-1,), (0.0,), (0,), (0,), (0,))]]


@query(f"WITH {STREAMS}, f AS (SELECT stream_id, chunk_id, count(DISTINCT value) AS c, max(value) - min(value) AS r FROM price GROUP BY ALL) SELECT stream_id, chunk_id, CASE WHEN r < 5000000 THEN 'range_pack' WHEN c >= 100 THEN 'zstd' ELSE 'field_lz' END AS label FROM f")
def plan_numeric_forest(s, d):
    features = P.features(streams.price(s, d)).select("stream_id", "chunk_id", "cardinality", "range_size")
    return graphs.forest_choice(features, ["cardinality", "range_size"], FORESTS, ["zstd", "range_pack", "field_lz"])


# -- codecs, parsers and selectors of the user; frames --


def pieces(data):
    """Sizes of the pieces of a text that end with a comma."""
    return [len(x) + 1 for x in data.split(b",")[:-1]] + [len(data.split(b",")[-1])]


def digits_apart(data):
    """(size, tag) of runs of digits (1) and of all others (0)."""
    import re

    return [(len(m[0]), int(m[0][:1].isdigit())) for m in re.finditer(rb"[0-9]+|[^0-9]+", data)]


USER = {"commas": custom.split_parser("commas", pieces), "digits": custom.dispatch_parser("digits", digits_apart), "etype": custom.tokens_of("etype", [b"c", b"e", b"p", b"s", b"v"])}
TEXTS = "SELECT event_id AS id, props, encode(props) AS b FROM events"


def frame_pieces(s, d):
    return custom.frames(props_blocks(s, d), custom.Plan("commas"), USER, "pieces")


@query(f"SELECT id, 0::BIGINT AS chunk_id, 1 AS version, 'pieces' AS comment, 1 AS outputs, 'serial' AS types, octet_length(b)::BIGINT AS size, 1 AS codecs, len(string_split(props, ','))::INT AS stored FROM ({TEXTS})")
def frame_info(s, d):
    return custom.info(frame_pieces(s, d))


@query(
    f"""SELECT id, 0 AS stream_no, NULL AS producer, 'commas' AS consumer, NULL::BIGINT AS stored_size FROM ({TEXTS})
    UNION ALL SELECT id, i::INT, 'commas', NULL, octet_length(encode(p[i])) + (i < len(p))::INT FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT id, string_split(props, ',') AS p FROM ({TEXTS})))"""
)
def frame_inspect(s, d):
    return custom.inspect(frame_pieces(s, d)).select("id", "stream_no", "producer", "consumer", "stored_size")


@query(f"SELECT id, k::INT AS stream_no, CASE WHEN k = 1 THEN length(regexp_replace(props, '[0-9]', '', 'g')) ELSE length(regexp_replace(props, '[^0-9]', '', 'g')) END::BIGINT AS stored_size FROM ({TEXTS}), (SELECT unnest([1, 2]) AS k) WHERE k = 1 OR regexp_matches(props, '[0-9]')")
def custom_dispatch_parser(s, d):
    out = custom.inspect(custom.frames(props_blocks(s, d), custom.Plan("digits"), USER))
    return out.where("producer = 'digits'").select("id", "stream_no", "stored_size")


@query(f"SELECT id, n, CASE WHEN n % 2 = 1 THEN 'delta8>huffman' ELSE 'zstd' END AS chosen, true AS restored FROM (SELECT id, octet_length(b)::BIGINT AS n FROM ({TEXTS}))")
def custom_selector(s, d):
    chosen = custom.frames(props_blocks(s, d), lambda streams: custom.Plan("delta8", then=(custom.Plan("huffman"),)) if len(streams[0]) % 2 else custom.Plan("zstd"))
    steps = custom.inspect(chosen).where("producer is not null").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stream_no", "producer"))), lambda r: r["producer"]), ">").alias("chosen"))
    return chosen.join(steps, "id").select("id", "n", "chosen", "restored")


@query(f"SELECT id, (i - 1)::BIGINT AS chunk_id, p[i] || CASE WHEN i < len(p) THEN ',' ELSE '' END AS text FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT id, string_split(props, ',') AS p FROM ({TEXTS})))")
def custom_segmenter(s, d):
    return custom.segmented(props_blocks(s, d), pieces).select("id", "chunk_id", F.decode("bytes", "UTF-8").alias("text"))


@query("SELECT event_id AS id, lpad((strpos('cepsv', event_type[1]) - 1)::VARCHAR, 2, '0') AS token, true AS restored FROM events")
def custom_tokens(s, d):
    rows = streams.table(s, d, "events").select(F.col("event_id").alias("id"), F.lit(0).alias("chunk_id"), F.encode(F.substring("event_type", 1, 1), "UTF-8").alias("bytes"))
    made = custom.frames(rows, custom.Plan("etype"), USER)
    return made.select("id", F.hex(F.substr("frame", F.octet_length("frame"), F.lit(1))).alias("token"), "restored")


@query(f"SELECT id, octet_length(b)::BIGINT AS n, true AS restored, true AS same_frame FROM ({TEXTS})")
def plan_serialised(s, d):
    plan = custom.Plan("commas", then=(custom.Plan("delta8", then=(custom.Plan("zstd"),)), custom.Plan("lz", then=(custom.Plan("huffman"),)), None))
    again = custom.from_json(custom.to_json(plan))
    a, b = (custom.frames(props_blocks(s, d), p, USER) for p in (plan, again))
    return a.join(b.select("id", F.col("frame").alias("other")), "id").select("id", "n", "restored", (F.col("frame") == F.col("other")).alias("same_frame"))


@query()
def plan_catalogue(s, d):
    return custom.listed(s)
