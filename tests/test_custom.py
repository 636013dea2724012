"""Huffman codes, structs, user codecs and frames, on fixed vectors and random content."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.functions import custom, graphs, huffman, records
from streamloom.operators import numeric as N
from streamloom.operators import structs as T

BLOBS = [b"", b"a", b"aaaa", b"abracadabra", bytes(range(256)) * 3, np.random.default_rng(1).integers(0, 9, 5000, np.uint8).tobytes()]


def test_huffman_fixed_vector():
    # abracadabra: a 1 bit, b and r 3 bits, c and d 3 bits: 5 + 2*3 + 2*3 + 3 + 3 = 23 bits
    lengths = huffman.code_lengths(np.bincount(np.frombuffer(b"abracadabra", np.uint8), minlength=256))
    assert {chr(i): int(lengths[i]) for i in np.flatnonzero(lengths)} == {"a": 1, "b": 3, "c": 3, "d": 3, "r": 3}
    codes = huffman.canonical(lengths)
    assert [int(codes[ord(c)]) for c in "abcdr"] == [0, 4, 5, 6, 7]
    stored = huffman.encode(b"abracadabra")
    bits = "".join({"a": "0", "b": "100", "c": "101", "d": "110", "r": "111"}[c] for c in "abracadabra")
    assert stored[:4] == (11).to_bytes(4, "little") and stored[260:] == int(bits.ljust(24, "0"), 2).to_bytes(3, "big")


@pytest.mark.parametrize("data", BLOBS)
def test_huffman_round_trip(data):
    assert huffman.decode(huffman.encode(data)) == data


@pytest.mark.parametrize("graph", ["huffman", "delta_huffman"])
@pytest.mark.parametrize("data", BLOBS)
def test_huffman_graphs(graph, data):
    steps = graphs.GRAPHS[graph]
    assert graphs.decode(graphs.encode(data, steps), steps) == data


def test_structs(spark):
    df = spark.createDataFrame([("s", 0, bytearray(bytes(range(24)))), ("s", 1, bytearray(b"\xff" * 8))], "stream_id string, chunk_id long, content binary")
    whole = T.from_serial(df, 8)
    assert {(r["chunk_id"], r["pos"]): bytes(r["value"]) for r in whole.collect()} == {(0, 0): bytes(range(8)), (0, 1): bytes(range(8, 16)), (0, 2): bytes(range(16, 24)), (1, 0): b"\xff" * 8}
    assert {r["chunk_id"]: bytes(r["content"]) for r in T.to_serial(whole).collect()} == {0: bytes(range(24)), 1: b"\xff" * 8}
    little = {(r["chunk_id"], r["pos"]): int(r["value"]) for r in T.to_numbers(whole, 8).collect()}
    assert little[0, 0] == int.from_bytes(bytes(range(8)), "little") and little[1, 0] == (1 << 64) - 1
    assert {(r["chunk_id"], r["pos"]): int(r["value"]) for r in T.to_numbers(whole, 8, big=True).collect()}[0, 1] == int.from_bytes(bytes(range(8, 16)), "big")
    fields = T.split_fields(whole, [1, 3, 4])
    assert {bytes(r["value"]) for r in fields.where("chunk_id = 0 and pos = 0").collect()} == {b"\0", b"\1\2\3", b"\4\5\6\7"}
    assert sorted(map(tuple, T.join_fields(fields).collect())) == sorted(map(tuple, whole.collect()))
    with pytest.raises(Exception, match="left over"):
        T.from_serial(df, 7).collect()
    with pytest.raises(Exception, match="do not cover"):
        T.split_fields(whole, [1, 2]).collect()


def test_dispatch_is_undone_from_tags_and_outputs(spark):
    df = spark.createDataFrame([("s", 0, i, int(v)) for i, v in enumerate(np.random.default_rng(2).integers(0, 50, 300))], "stream_id string, chunk_id long, pos long, value long")
    tags, outputs = N.dispatched(N.dispatch(df, F.col("value") % 7))
    assert "pos" not in outputs.columns and "value" not in tags.columns
    assert sorted(map(tuple, N.undo_dispatch(tags, outputs).collect())) == sorted(map(tuple, df.collect()))


def halves(data):
    return [len(data) // 2, len(data) - len(data) // 2]


def parity(data):
    return [(1, x % 2) for x in data]


USER = {
    "halves": custom.split_parser("halves", halves), "parity": custom.dispatch_parser("parity", parity), "shift": custom.typed("shift", lambda d, by: (bytes([by]), [bytes((x + by) % 256 for x in d)]), lambda h, s, by: bytes((x - h[0]) % 256 for x in s[0])),
}


@pytest.mark.parametrize("data", BLOBS)
def test_frames(data):
    plan = custom.Plan("halves", then=(custom.Plan("shift", {"by": 3}, (custom.Plan("parity", then=(None, custom.Plan("huffman"))),)), custom.Plan("delta16", then=(custom.Plan("zstd"),))))
    seen = []
    frame = custom.compress(plan, [data], USER, "remark", hooks=(lambda *x: seen.append(x),))
    assert custom.decompress(frame, USER) == [data]
    m, _ = custom.manifest_of(frame)
    assert m["comment"] == "remark" and m["inputs"] == [{"type": "serial", "size": len(data)}]
    assert [x[1] for x in seen if x[0] == "codec"] == [c["name"] for c in m["codecs"]]
    assert custom.compress(custom.from_json(custom.to_json(plan)), [data], USER, "remark") == frame


def test_frames_of_several_inputs_and_functions():
    inputs = [b"abcdef", b"ABCDEF", b"123456"]
    frame = custom.compress(custom.Plan("interleave", {"width": 2}), inputs)
    assert custom.manifest_of(frame)[0]["stored"] == [[3, 18]] and frame.endswith(b"abAB12cdCD34efEF56")
    assert custom.decompress(frame) == inputs
    pick = lambda streams: custom.Plan("constant") if len(set(streams[0])) == 1 else None
    for data, n in ((b"zzzz", 1), (b"zy", 0)):
        made = custom.compress(pick, [data])
        assert len(custom.manifest_of(made)[0]["codecs"]) == n and custom.decompress(made) == [data]
    with pytest.raises(custom.FrameError):
        custom.to_json(custom.Plan("zstd", then=(pick,)))
    with pytest.raises(custom.FrameError):
        custom.decompress(b"else")
    with pytest.raises(custom.FrameError):
        custom.compress(custom.Plan("interleave", {"width": 2}), [b"ab", b"abcd"])


@pytest.mark.parametrize("line", ["push.nothing", "math.nothing", "push.u32", "type.nothing", "nothing.at_all", "cmp.nothing"])
def test_records_with_unknown_operations_are_errors_of_the_blob(spark, line):
    df = spark.createDataFrame([(1, bytearray(b"abc"))], "id long, content binary")
    r = records.segments(df, "id", "content", f"push.zero\npush.zero\n{line}").first()
    assert r["error"] and r["segment_no"] is None


def test_tags_are_limited():
    program = records.assemble("\n".join(f"push.tag {i}\npush.type.u8\npush.u32 1\nsegment.create_tagged" for i in range(records.MAX_TAGS + 1)))
    with pytest.raises(records.RecordError):
        records.Machine(program, bytes(records.MAX_TAGS + 1)).run()
