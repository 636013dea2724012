"""Entropy coders, transforms and graphs: round trips on odd blocks, and results that are known from elsewhere."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streamloom.functions import blocks, coders, graphs, lockstep, transforms
from streamloom.plans import reports

BLOCKS = [
    b"", b"a", b"ab", b"aaaa" * 300, bytes(range(256)), b"banana", b"the quick brown fox jumps over the lazy dog " * 20, "\u017elu\u0165ou\u010dk\u00fd k\u016f\u0148 \u65e5\u672c\u8a9e".encode() * 9,
    b"ACGTNACGTTTTGA" * 20, b"\xe8\x01\x02\x03\x00abc\xe9\xff\xff\xff\xff\xff" * 30, b"\xff" * 40, b"\xff\xff\x00", b"\xeb" * 33, b"\x00\x00\x00\x94" * 9 + b"\x48\x00\x00\x01" * 3,
]


@pytest.mark.parametrize("name", sorted(blocks.TRANSFORMS))
def test_transforms_restore(name):
    there, back = blocks.TRANSFORMS[name]
    for x in BLOCKS:
        assert back(there(x)) == x


@pytest.mark.parametrize("name", sorted(set(graphs.GRAPHS) - {"constant"}))
def test_graphs_restore(name):
    for x in BLOCKS:
        assert graphs.decode(graphs.encode(x, graphs.GRAPHS[name]), graphs.GRAPHS[name]) == x


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=80), st.lists(st.sampled_from(b"ab\xe8\x00\xff\xeb\x94H\x01 "), max_size=80).map(bytes)))
def test_any_block(x):
    for name, (there, back) in blocks.TRANSFORMS.items():
        assert back(there(x)) == x, name
    for name in ("field_lz8", "field_lz32", "partition_bitpack16", "tokenize16_delta_field_lz"):
        assert graphs.decode(graphs.encode(x, graphs.GRAPHS.get(name) or (name,)), graphs.GRAPHS.get(name) or (name,)) == x


def test_published_sorts():
    assert transforms.bijective_sort(b"banana") == b"annbaa"
    assert blocks.bwt(b"banana") == b"\x03\x00\x00\x00" + b"nnbaaa"
    assert blocks.move_to_front(b"bananaaa") == bytes([98, 98, 110, 1, 1, 1, 0, 0])


def test_call_targets():
    assert transforms.calls(b"\x90\xe8\x0a\x00\x00\x00\x90") == b"\x90\xe8\x10\x00\x00\x00\x90"
    assert transforms.branches(b"\x00" * 4 + b"\x02\x00\x00\xeb", "arm") == b"\x00" * 4 + b"\x03\x00\x00\xeb"


@pytest.mark.parametrize("name", ["fse", "ans0", "range", "fpaq"])
def test_close_to_entropy(name):
    x = b"the quick brown fox jumps over the lazy dog " * 40
    bits = -sum(c * math.log2(c / len(x)) for c in Counter(x).values())
    assert bits / 8 <= len(coders.CODERS[name][0](x)) <= 1.02 * bits / 8 + 60


def test_context_coders_gain():
    x = b"the quick brown fox jumps over the lazy dog " * 40
    size = {n: len(coders.CODERS[n][0](x)) for n in ("ans0", "ans1", "cm", "tpaq", "fpaq")}
    assert size["ans1"] < size["ans0"] and size["cm"] < size["fpaq"] / 5 and size["tpaq"] < size["fpaq"] / 5


def test_counts():
    for counts in ([1], [0, 5, 0, 0, 9], [1] * 256, [10**9, 1, 1]):
        padded = counts + [0] * (256 - len(counts))
        norm = coders.normalised(padded)
        assert norm.sum() == 1 << coders.LOG and all((n > 0) == (c > 0) for n, c in zip(norm, padded))
        assert coders.unpack_counts(coders.pack_counts(norm))[0].tolist() == norm.tolist()


def test_field_lz_matches_elements():
    x = b"".join(i.to_bytes(4, "little") for i in [7, 8, 9, 10] * 100)
    assert len(graphs.encode(x, ("field_lz32",))) < 150


@pytest.mark.parametrize("name", sorted(lockstep.MANY))
def test_many_blocks_at_once_are_coded_as_each_alone(name):
    words = [b"", b"\0", b"a", b"a" * 70, bytes(range(256)), bytes(range(40)) * 3, b"\xff" * 5, b"abcabcabcd" * 9, b"ab\0\0" * 30]
    data = [w * k + w[::-2] for k in (1, 2) for w in words] + [f"steel/{i * 7919}/brass/{i}".encode() * (1 + i % 4) for i in range(40)]
    code, undo = coders.CODERS[name]
    stored = lockstep.MANY[name][0](data)
    assert stored == [code(x) for x in data]
    assert lockstep.MANY[name][1](stored) == data == [undo(x) for x in stored]


@pytest.mark.parametrize("name", sorted(lockstep.MANY))
def test_queries_on_blocks_do_not_code_one_by_one(name, monkeypatch):
    """Blocks of like lengths never reach the coder of a single block."""

    def refuse(x):
        raise AssertionError("one by one")

    monkeypatch.setitem(blocks.TRANSFORMS, name, (refuse, refuse))
    data = [f"nickel {i:04d} copper {i * i:08d}".encode() for i in range(64)]
    assert blocks.undo_many(blocks.chain_many(data, [name]), [name]) == data


def test_brute_force_codes_blocks_together(monkeypatch):
    """The smallest results are those of every graph by itself; coders see all blocks of a batch at once."""
    data = [b'{"k": %d}' % i for i in range(40)] + [b"", b"ab" * 50, b"\1\0\0\0" * 9]
    want = []
    for x in data:
        made = []
        for name, graph in graphs.TRIED.items():
            try:
                made.append((len(y := graphs.encode(x, graph)), len(made), name, y))
            except ValueError:
                continue
        want.append(min(made)[2:])
    monkeypatch.setitem(graphs.PLAIN, "fse", None)
    graphs.node.cache_clear()
    try:
        assert graphs.smallest(data, graphs.TRIED) == want
    finally:
        graphs.node.cache_clear()


def test_brute_force_tries_every_named_graph(spark):
    """The sizes are the least over all named graphs, adaptive coders as well, on blocks of like lengths and on others."""
    data = [f"copper {i * 7919} burnished almond {i} steel".encode() for i in range(20)] + [b"", b"\0", b"a" * 90, b"the small brown pot " + bytes(range(97, 123)) + b" stands under a small tree" * 3]
    for x, row in zip(data, graphs.try_all(spark.createDataFrame([(i, 0, x) for i, x in enumerate(data)], "id long, chunk_id long, bytes binary")).orderBy("id").collect()):
        sizes = {name: len(graphs.encode(x, g)) for name, g in graphs.GRAPHS.items() if name != "constant" or len(set(x)) == 1}
        assert row["size"] == min(sizes.values()) and row["graph"] == min(sizes, key=sizes.get) and row["n"] == len(x) and row["restored"]
        if x and len(set(x)) > 1:
            assert row["graph"] in coders.MIXTURES


def test_brute_force_of_null_blocks(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "ab")], "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    rows = reports.QUERIES["graph_brute_force"](spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, None, True, True), (2, 0, True, True), (3, 2, True, True)]


def test_brute_force_decodes_adaptive_results_together(monkeypatch):
    def refuse(x):
        raise AssertionError("one by one")

    monkeypatch.setitem(graphs.PLAIN, "cm", graphs.Node("cm", refuse, refuse))
    graphs.node.cache_clear()
    try:
        data = [f"nickel {i:04d} nickel nickel {i * i:08d} nickel".encode() for i in range(64)]
        assert {(name, same) for name, _, _, same in graphs.chosen(data, {"cm": ("cm",)})} == {("cm", True)}
    finally:
        graphs.node.cache_clear()


def test_brute_force_encodes_equal_blocks_once(monkeypatch):
    seen = []
    monkeypatch.setitem(graphs.PLAIN, "store", graphs.Node("store", lambda x: (seen.append(x), x)[1], bytes))
    graphs.node.cache_clear()
    try:
        assert graphs.chosen([b"%d" % (i % 5) for i in range(1000)], {"store": ("store",)}) == [("store", 1, 1, True)] * 1000
    finally:
        graphs.node.cache_clear()
    assert sorted(seen) == [b"%d" % i for i in range(5)]
