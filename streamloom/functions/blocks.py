"""Reversible transforms of byte blocks: sorting, moving to front, runs, ranks, aliases. One pure function each way.

They are applied to blocks of bounded size (sources.streams.blocks), so a task holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.functions.coders import CODERS
from streamloom.functions.lockstep import MANY
from streamloom.functions.transforms import MORE
from streamloom.sources.streams import spread

def as_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def suffix_order(b: np.ndarray) -> np.ndarray:
    """Order of the rotations by prefix doubling."""
    n = len(b)
    rank = b.astype(np.int64)
    k = 1
    while True:
        second = np.roll(rank, -k)
        order = np.lexsort((second, rank))
        changed = np.concatenate([[0], (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)]).astype(np.int64)
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(changed)
        if new.max() == n - 1 or k >= n:
            return order
        rank, k = new, 2 * k


def bwt(data: bytes) -> bytes:
    """Last column of the sorted rotations, after the row of the original (4 bytes)."""
    if not data:
        return b""
    b = as_bytes(data)
    order = suffix_order(b)
    row = int(np.flatnonzero(order == 0)[0])
    return row.to_bytes(4, "little") + b[order - 1].tobytes()


def undo_bwt(data: bytes) -> bytes:
    if not data:
        return b""
    row, last = int.from_bytes(data[:4], "little"), as_bytes(data[4:])
    follow = np.argsort(last, kind="stable")
    out = np.empty(len(last), np.uint8)
    at = row
    for i in range(len(last)):
        at = follow[at]
        out[i] = last[at]
    return out.tobytes()


def move_to_front(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for c in data:
        i = table.index(c)
        out.append(i)
        if i:
            table.insert(0, table.pop(i))
    return bytes(out)


def undo_move_to_front(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for i in data:
        c = table[i]
        out.append(c)
        if i:
            table.insert(0, table.pop(i))
    return bytes(out)


def run_length(data: bytes) -> bytes:
    """Pairs of a byte and its run's length less one; longer runs than 256 are cut."""
    b = as_bytes(data)
    if not len(b):
        return b""
    edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    length = np.diff(np.append(edge, len(b)))
    pieces = -(-length // 256)
    value = np.repeat(b[edge], pieces)
    left = np.full(len(value), 256)
    left[np.cumsum(pieces) - 1] = length - 256 * (pieces - 1)
    return np.stack([value, (left - 1).astype(np.uint8)], 1).tobytes()


def undo_run_length(data: bytes) -> bytes:
    pairs = as_bytes(data).reshape(-1, 2)
    return np.repeat(pairs[:, 0], pairs[:, 1].astype(np.int64) + 1).tobytes()


def zero_runs(data: bytes) -> bytes:
    """A run of zeros becomes a zero and its length less one; other bytes stay."""
    out, i = bytearray(), 0
    while i < len(data):
        if data[i]:
            out.append(data[i])
            i += 1
            continue
        n = 1
        while n < 256 and i + n < len(data) and data[i + n] == 0:
            n += 1
        out += bytes([0, n - 1])
        i += n
    return bytes(out)


def undo_zero_runs(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        if data[i]:
            out.append(data[i])
            i += 1
        else:
            out += bytes(data[i + 1] + 1)
            i += 2
    return bytes(out)


def sorted_rank(data: bytes) -> bytes:
    """Bytes as ranks by falling frequency, after the table of ranks (256 bytes)."""
    b = as_bytes(data)
    order = np.argsort(-np.bincount(b, minlength=256), kind="stable").astype(np.uint8)
    rank = np.empty(256, np.uint8)
    rank[order] = np.arange(256)
    return order.tobytes() + rank[b].tobytes()


def undo_sorted_rank(data: bytes) -> bytes:
    return as_bytes(data[:256])[as_bytes(data[256:])].tobytes()


def alias_pack(data: bytes) -> bytes:
    """Up to 16 different bytes: their alphabet, then two to a byte (up to 4: four to a byte); else as it is."""
    b = as_bytes(data)
    symbols, index = np.unique(b, return_inverse=True)
    if len(symbols) > 16 or not len(b):
        return b"\x00" + data
    bits = 2 if len(symbols) <= 4 else 4
    per = 8 // bits
    padded = np.concatenate([index, np.zeros(-len(index) % per, np.int64)]).reshape(-1, per)
    packed = (padded << (bits * np.arange(per))).sum(axis=1).astype(np.uint8)
    return bytes([bits, len(symbols)]) + len(b).to_bytes(4, "little") + symbols.tobytes() + packed.tobytes()


def undo_alias_pack(data: bytes) -> bytes:
    if data[0] == 0:
        return data[1:]
    bits, n, size = data[0], data[1], int.from_bytes(data[2:6], "little")
    symbols, packed = as_bytes(data[6 : 6 + n]), as_bytes(data[6 + n :])
    per = 8 // bits
    return symbols[((packed[:, None] >> (bits * np.arange(per))) & ((1 << bits) - 1)).ravel()[:size]].tobytes()


def step_delta(data: bytes, step: int = 4) -> bytes:
    b = as_bytes(data)
    out = b.copy()
    out[step:] = b[step:] - b[:-step] if len(b) > step else out[step:]
    return out.tobytes()


def undo_step_delta(data: bytes, step: int = 4) -> bytes:
    b = as_bytes(data)
    padded = np.concatenate([b, np.zeros(-len(b) % step, np.uint8)]).reshape(-1, step)
    return np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[: len(b)].tobytes()


def byte_transpose(data: bytes, width: int = 4) -> bytes:
    n = len(data) // width * width
    return as_bytes(data[:n]).reshape(-1, width).T.tobytes() + data[n:]


def undo_byte_transpose(data: bytes, width: int = 4) -> bytes:
    n = len(data) // width * width
    return as_bytes(data[:n]).reshape(width, -1).T.tobytes() + data[n:]


TRANSFORMS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "none": (bytes, bytes), "bwt": (bwt, undo_bwt), "mtf": (move_to_front, undo_move_to_front), "rlt": (run_length, undo_run_length), "zrlt": (zero_runs, undo_zero_runs),
    "srt": (sorted_rank, undo_sorted_rank), "pack": (alias_pack, undo_alias_pack), "mm": (step_delta, undo_step_delta), "transpose": (byte_transpose, undo_byte_transpose),
    **MORE, **CODERS,
}


def chain(data: bytes, names: list[str]) -> bytes:
    for n in names:
        data = TRANSFORMS[n][0](data)
    return data


def undo_chain(data: bytes, names: list[str]) -> bytes:
    for n in reversed(names):
        data = TRANSFORMS[n][1](data)
    return data


def chain_many(data: list[bytes], names: list[str]) -> list[bytes]:
    """chain of each block; entropy coders take all blocks at once."""
    for n in names:
        data = MANY[n][0](data) if n in MANY else [TRANSFORMS[n][0](x) for x in data]
    return data


def undo_many(data: list[bytes], names: list[str]) -> list[bytes]:
    for n in reversed(names):
        data = MANY[n][1](data) if n in MANY else [TRANSFORMS[n][1](x) for x in data]
    return data


def apply(blocks: DataFrame, names: list[str], verify: bool = True) -> DataFrame:
    """id, chunk_id, bytes of the transformed blocks, and whether undoing gives the block back (null without verify, for callers
    who undo what is stored themselves). At most 8 transforms."""
    if len(names) > 8 or any(n not in TRANSFORMS for n in names):
        raise ValueError("up to 8 known transforms")

    def run(batches):
        for b in batches:
            data = [x or b"" for x in b.column("bytes").to_pylist()]
            made = chain_many(data, names)
            same = [x == y for x, y in zip(undo_many(made, names), data)] if verify else [None] * len(data)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("chunk_id"), pa.array(made, pa.binary()), pa.array(same, pa.bool_())], names=["id", "chunk_id", "bytes", "restored"])

    rows = blocks.select(F.col("id").cast("long"), F.col("chunk_id").cast("long"), F.col("bytes").cast("binary"))
    return spread(rows, "id", "chunk_id").mapInArrow(run, "id long, chunk_id long, bytes binary, restored boolean")


def undo(blocks: DataFrame, names: list[str]) -> DataFrame:
    """id, chunk_id, bytes of blocks as they were before the transforms, from the transformed bytes alone."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("chunk_id"), pa.array(undo_many([x or b"" for x in b.column("bytes").to_pylist()], names), pa.binary())], names=["id", "chunk_id", "bytes"])

    return blocks.select("id", "chunk_id", "bytes").mapInArrow(run, "id long, chunk_id long, bytes binary")


def huffman_bits(counts: np.ndarray) -> int:
    """Bits of a Huffman code for symbols that occur so often."""
    import heapq

    heap = sorted(int(c) for c in counts if c)
    if len(heap) < 2:
        return sum(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def huffman_sizes(blocks: DataFrame) -> DataFrame:
    """id, chunk_id, n, huffman_bytes: code lengths as they would be, with a header of 4 bits a symbol and 4 bytes."""

    def run(batches):
        for b in batches:
            data = [as_bytes(x or b"") for x in b.column("bytes").to_pylist()]
            counts = [np.bincount(x, minlength=256) for x in data]
            size = [4 if len(x) <= 4 else -(-huffman_bits(c) // 8) + -(-int((c > 0).sum()) // 2) + 4 for x, c in zip(data, counts)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("chunk_id"), pa.array([len(x) for x in data], pa.int64()), pa.array(size, pa.int64())], names=["id", "chunk_id", "n", "huffman_bytes"])

    return blocks.select(F.col("id").cast("long"), F.col("chunk_id").cast("long"), F.col("bytes").cast("binary")).mapInArrow(run, "id long, chunk_id long, n long, huffman_bytes long")


def huffman(blocks: DataFrame) -> DataFrame:
    """id, chunk_id, n, bytes (Huffman codes of the block), restored, and whether the codes take less than the entropy and one
    bit for each byte."""
    from streamloom.functions import huffman as H

    def run(batches):
        for b in batches:
            data = [x or b"" for x in b.column("bytes").to_pylist()]
            made = [H.encode(x) for x in data]
            near = []
            for x, m in zip(data, made):
                p = np.bincount(as_bytes(x), minlength=256) / max(len(x), 1)
                p = p[p > 0]
                bits = 8 * (len(m) - (260 if len(p) > 1 else len(m)))
                near.append(bool(bits <= -(p * np.log2(p)).sum() * len(x) + len(x) + 8))
            columns = [pa.array([len(x) for x in data], pa.int64()), pa.array(made, pa.binary()), pa.array([H.decode(m) == x for x, m in zip(data, made)]), pa.array(near)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("chunk_id"), *columns], names=["id", "chunk_id", "n", "bytes", "restored", "within_a_bit_of_entropy"])

    rows = blocks.select(F.col("id").cast("long"), F.col("chunk_id").cast("long"), F.col("bytes").cast("binary"))
    return rows.mapInArrow(run, "id long, chunk_id long, n long, bytes binary, restored boolean, within_a_bit_of_entropy boolean")
