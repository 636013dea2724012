"""Stored blobs, their ranges and joins; choices over histograms."""

import math

import pytest

from streamloom.plans import choose
from streamloom.sources import store

BLOBS = [(1, b""), (2, None), (3, b"abc" * 100), (4, bytes(range(256)) * 5), (9000, "ž日".encode() * 40)]


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame(BLOBS, "id long, bytes binary")


@pytest.mark.parametrize("start,length", [(0, None), (0, 0), (5, 7), (63, 2), (64, 64), (250, 100), (10**6, 5)])
def test_ranges(blobs, start, length):
    got = {r["id"]: bytes(r["bytes"]) for r in store.read(store.pack(blobs, size=64), start=start, length=length).collect()}
    end = None if length is None else start + length
    assert got == {i: (b or b"")[start:end] for i, b in BLOBS}


def test_blocks_keep_to_the_codecs_limit(blobs):
    made = store.pack(blobs, "zlib", 6, size=1000, max_input=100)
    assert made.agg({"size": "max"}).collect()[0][0] == 100
    assert {r["id"]: bytes(r["bytes"]) for r in store.read(made, "zlib").collect()} == {i: b or b"" for i, b in BLOBS}


def test_joined(blobs):
    at, want = 0, {}
    for i, b in BLOBS:
        want[i] = (at, len(b or b""))
        at += want[i][1]
    assert {r["id"]: (r["start"], r["size"]) for r in store.joined(blobs, 2).collect()} == want


def test_contexts_merge_where_it_costs_little(spark):
    like = {0: {1: 500, 2: 500}, 1: {1: 480, 2: 510}, 2: {7: 900}, 3: {7: 3, 1: 2}, 4: {9: 400, 8: 400}}
    rows = [("s", c, x, n) for c, h in like.items() for x, n in h.items()]
    got = {r["context"]: r["cluster"] for r in choose.merged_contexts(spark.createDataFrame(rows, "stream_id string, context long, symbol long, n long")).collect()}

    def bits(h):
        return sum(n * math.log2(sum(h.values()) / n) for n in h.values())

    def union(a, b):
        return {x: a.get(x, 0) + b.get(x, 0) for x in {*a, *b}}

    groups = {c: ([c], h) for c, h in like.items()}
    while True:
        best = min((round(bits(union(groups[a][1], groups[b][1])) - bits(groups[a][1]) - bits(groups[b][1]), 6), a, b) for a in groups for b in groups if a < b)
        if best[0] >= 64:
            break
        _, a, b = best
        groups[a] = (groups[a][0] + groups[b][0], union(groups[a][1], groups[b][1]))
        del groups[b]
    assert got == {c: k for k, (m, _) in groups.items() for c in m}
    assert got[0] == got[1] and got[2] not in (got[0], got[4]) and got[4] == 4
