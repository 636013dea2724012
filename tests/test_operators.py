"""Worked examples, odd inputs, round trips and errors."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamloom.functions import blocks, chunking, codecs, records
from streamloom.operators import numeric as N
from streamloom.operators import profile as P
from streamloom.operators import strings as S
from streamloom.sources import streams


def numbers(spark, values, chunk=0):
    return spark.createDataFrame([("s", chunk, i, v) for i, v in enumerate(values)], "stream_id string, chunk_id long, pos long, value long")


def words(spark, values):
    return spark.createDataFrame([("s", 0, i, v) for i, v in enumerate(values)], "stream_id string, chunk_id long, pos long, value string")


def out(df, *cols):
    rows = [r.asDict() for r in df.collect()]
    keys = [c for c in ("pos", "n", "token") if rows and c in rows[0]][:1]
    rows.sort(key=lambda r: [r[k] for k in keys])
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in rows]


@pytest.mark.parametrize(("given_", "suffix", "shared"), [(["app", "apple", "apple pie", "apple pies"], ["app", "le", " pie", "s"], [0, 3, 5, 9]), (["a", "b", "c"], ["a", "b", "c"], [0, 0, 0]), (["a", "aa", "aaa"], ["a", "a", "a"], [0, 1, 2]), (["é", "è", ""], None, [0, 1, 0])])
def test_prefix(spark, given_, suffix, shared):
    got = S.prefix(words(spark, given_))
    assert out(got, "shared") == shared
    if suffix:
        assert out(got, "suffix") == suffix
        assert out(S.undo_prefix(got), "value") == given_


def test_run_lengths(spark):
    v = [3, 9, 9, 4, 4, 4] + [0] * 10 + [1] * 6
    got = N.run_lengths(numbers(spark, v))
    assert out(got, "value", "length") == [(3, 1), (9, 2), (4, 3), (0, 10), (1, 6)]
    assert out(N.undo_run_lengths(got), "value") == v


SERIES = [15000, 15001, 15002, 15003, 15004, 15204, 15104, 15103, 15102, 15101, 15100]


def test_delta_and_range(spark):
    df = numbers(spark, SERIES)
    assert out(N.delta(df), "value") == [15000, 1, 1, 1, 1, 200, -100, -1, -1, -1, -1]
    assert out(N.range_pack(df), "value") == [0, 1, 2, 3, 4, 204, 104, 103, 102, 101, 100]
    assert out(N.range_pack(df), "width")[0] == 1
    assert N.bit_pack(N.range_pack(df).select("stream_id", "chunk_id", "pos", "value")).first()["bits"] == 8


def test_transpose(spark):
    got = N.transpose_split(numbers(spark, [1 | 2 << 8 | 3 << 16 | 4 << 24, 5 | 6 << 8 | 7 << 16 | 8 << 24]), 4)
    lanes = {i: sorted((r["pos"], r["value"]) for r in got.collect() if r["lane"] == i) for i in range(4)}
    assert [[v for _, v in lanes[i]] for i in range(4)] == [[1, 5], [2, 6], [3, 7], [4, 8]]


def test_sparse(spark):
    for v in ([0, 0, 5, 0, 7, 0, 0], [1, 2], [0, 0], [0], [4]):
        got = N.sparse(numbers(spark, v))
        assert out(N.undo_sparse(got), "value") == v
    got = N.sparse(numbers(spark, [0, 0, 5, 0, 7, 0, 0]))
    assert out(got, "distance", "literal") == [(2, 5), (1, 7), (2, None)]


def test_signed_extremes(spark):
    v = [0, -1, (1 << 62), -(1 << 62), 1]
    assert out(N.undo_zigzag(N.zigzag(numbers(spark, v))), "value") == v


def test_errors(spark):
    for made in (N.quantize_offsets(numbers(spark, [1, 0])), N.divide_by(numbers(spark, [4, 5]), 2), N.merge_sorted(numbers(spark, list(range(70, 0, -1)))), S.parse_int(words(spark, ["1", "01"])), N.split_n(numbers(spark, [1, 2, 3]), [1, 1]), N.dedup([numbers(spark, [1]), numbers(spark, [2])])):
        with pytest.raises(Exception):
            made.collect()


def test_empty_streams(spark):
    none = numbers(spark, [])
    for made in (N.delta(none), N.zigzag(none), N.range_pack(none), N.sparse(none), N.run_lengths(none), N.tokenize(none)[1], N.bit_pack(none), P.entropy(none), P.sizes(none), N.split_by_range(none), N.divide_by(none)):
        assert made.count() == 0


def test_approximate_cardinality(spark):
    df = numbers(spark, [i % 700 for i in range(5000)])
    assert abs(P.approximate_cardinality(df).first()["cardinality"] - 700) < 70
    linear = P.linear_counting_error(df).first()
    assert abs(linear["estimate"] - 700) <= 700 * linear["bound"]


BLOB = st.one_of(st.binary(max_size=300), st.lists(st.sampled_from([0, 0, 0, 1, 7]), max_size=600).map(bytes))


@settings(max_examples=60, deadline=None)
@given(BLOB)
def test_block_transforms(data):
    for name, (there, back) in blocks.TRANSFORMS.items():
        assert back(there(data)) == data, name
    assert blocks.undo_chain(blocks.chain(data, ["bwt", "mtf", "zrlt"]), ["bwt", "mtf", "zrlt"]) == data


def test_bwt_groups_equal_contexts():
    assert blocks.bwt(b"banana")[4:] == b"nnbaaa"


@settings(max_examples=40, deadline=None)
@given(BLOB)
def test_codecs(data):
    for name, (pack, unpack) in codecs.bindings().items():
        first, last = codecs.levels()[name]
        assert unpack(pack(data, max(first, min(last, 1))), len(data)) == data, name


def test_codec_lists():
    assert codecs.expand("bzip2,1,9") == [("bzip2", 1), ("bzip2", 9)]
    assert codecs.expand("zlib,2-4") == [("zlib", 2), ("zlib", 3), ("zlib", 4)]
    assert codecs.expand("lzo1") == [("lzo1", 1), ("lzo1", 99)]
    assert codecs.expand("UCL")[0][0] == "ucl_nrv2b" and ("glza", 0) in codecs.expand("SLOW")
    assert len({n for n, _ in codecs.expand("ALL")}) > 50


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "x.bin").write_bytes(b"abc")
    (tmp_path / "a/y.bin").write_bytes(b"defg")
    assert streams.files(spark, [str(tmp_path)], recursive=True).agg(F.sum("length")).first()[0] == 7
    assert streams.files(spark, [str(tmp_path / "x.bin")]).count() == 1


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000))
def test_fragments_cover(data):
    ends = chunking.cuts(data, 64)
    assert ends == sorted(set(ends)) and (ends[-1:] == [len(data)] or not data)
    assert all(b - a <= 8 * 64 for a, b in zip([0, *ends], ends))


def test_fragments_survive_an_insertion():
    data = os.urandom(20000)
    pieces = lambda d: {d[a:b] for e in [chunking.cuts(d, 256)] for a, b in zip([0, *e], e)}
    assert len(pieces(data) & pieces(data[:5000] + b"inserted" + data[5000:])) > 0.8 * len(pieces(data))


def run(source, data=b""):
    return records.Machine(records.assemble(source), data).run()


def test_record_machine():
    assert run("push.tag 7\npush.type.u16le\npush.u32 2\nsegment.create_tagged", b"abcd") == [(7, "u16le", 0, 4)]
    assert run("push.u32 0\nload.i16be\npush.i32 -2\ncmp.eq\nexpect_true\npush.remaining\nsegment.create_unspecified", b"\xff\xfe") == [(-1, "bytes", 0, 2)]
    assert run("push.u32 2\npush.u32 1\njump_if\npush.zero\nexpect_true\nhalt") == []
    assert run("push.u32 3\npush.u32 9\nvar.store\npush.u32 3\nvar.load\npush.u32 9\ncmp.eq\nexpect_true") == []
    assert run("push.i32 -7\npush.u32 2\nmath.div\npush.i32 -3\ncmp.eq\nexpect_true\npush.i32 -7\npush.u32 2\nmath.mod\npush.i32 -1\ncmp.eq\nexpect_true") == []
    for bad in ("math.add", "push.zero\npush.zero\nmath.div", "push.i64 9223372036854775807\npush.u32 1\nmath.add", "push.u32 9\nload.u8", "push.zero\nexpect_true", "push.i32 -1\npush.u32 1\njump_if"):
        with pytest.raises(records.RecordError):
            run(bad)


def test_huffman_bits():
    import numpy as np

    assert blocks.huffman_bits(np.array([1, 1, 2])) == 6
    assert blocks.huffman_bits(np.array([5])) == 5


def test_streaming_profile(spark, tmp_path):
    from streamloom.streaming import profiles

    src, dst = tmp_path / "in", tmp_path / "out"
    rng = random.Random(1)
    spark.createDataFrame([(i, rng.random()) for i in range(500)], "i long, v double").selectExpr("timestamp_seconds(i * 60) as ts", "v as value", "cast(i % 3 as string) as k").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, value double, k string").parquet(str(src))
    q = profiles.windowed_profile(stream, "ts", "value", "k").writeStream.format("memory").queryName("profiled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(dst)).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("profiled").collect()}
    want = {tuple(r) for r in profiles.windowed_profile(spark.read.parquet(str(src)), "ts", "value", "k").collect()}
    assert got == want and len(want) == 27


@settings(max_examples=60, deadline=None)
@given(BLOB)
def test_graphs(data):
    from streamloom.functions import graphs

    for name, graph in graphs.GRAPHS.items():
        if name == "constant" and len(set(data)) != 1:
            continue
        assert graphs.decode(graphs.encode(data, graph), graph) == data, name


def test_forest_follows_missing_values():
    import numpy as np

    from streamloom.functions.graphs import Tree

    tree = Tree((0, -1, -1), (1.0, 10.0, 20.0), (1, 0, 0), (2, 0, 0), (2, 0, 0))
    assert tree.score(np.array([[0.0], [1.0], [np.nan]])).tolist() == [10.0, 20.0, 20.0]
