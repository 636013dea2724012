"""Encoding graphs over blocks of bytes: chains of typed nodes that end in a store or a codec, each with its inverse.

A graph is a tuple of nodes. A node turns bytes into a header and bytes, and back. Nodes of `width` look at the block as
little-endian unsigned integers; what does not fill an integer travels in the header. try_all encodes each block with
every graph of a list and keeps the strictly smallest result (ties: the first), as a selector by brute force does.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.functions import huffman
from streamloom.functions.coders import CODERS
from streamloom.functions.lockstep import MANY
from streamloom.functions.transforms import MORE
from streamloom.sources.streams import spread


@dataclass(frozen=True)
class Node:
    name: str
    encode: Callable[[bytes], bytes]
    decode: Callable[[bytes], bytes]


def framed(header: bytes, body: bytes) -> bytes:
    return struct.pack("<I", len(header)) + header + body


def unframed(data: bytes) -> tuple[bytes, bytes]:
    n = struct.unpack_from("<I", data)[0]
    return data[4 : 4 + n], data[4 + n :]


def split_ints(data: bytes, width: int) -> tuple[np.ndarray, bytes]:
    n = len(data) // width * width
    return np.frombuffer(data[:n], f"<u{width}"), data[n:]


def delta(width: int) -> Node:
    def encode(data):
        x, tail = split_ints(data, width)
        return framed(tail, np.diff(x, prepend=x.dtype.type(0)).tobytes())

    def decode(data):
        tail, body = unframed(data)
        return np.cumsum(np.frombuffer(body, f"<u{width}"), dtype=f"<u{width}").tobytes() + tail

    return Node(f"delta{8 * width}", encode, decode)


def zigzag(width: int) -> Node:
    def encode(data):
        x, tail = split_ints(data, width)
        s = x.view(f"<i{width}")
        return framed(tail, ((s << 1) ^ (s >> (8 * width - 1))).tobytes())

    def decode(data):
        tail, body = unframed(data)
        x = np.frombuffer(body, f"<u{width}")
        return ((x >> x.dtype.type(1)) ^ (~(x & x.dtype.type(1)) + x.dtype.type(1))).tobytes() + tail

    return Node(f"zigzag{8 * width}", encode, decode)


def narrowest(top: int) -> int:
    return next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)


def range_pack(width: int) -> Node:
    def encode(data):
        x, tail = split_ints(data, width)
        low, top = (int(x.min()), int(x.max())) if len(x) else (0, 0)
        to = narrowest(top - low)
        return framed(struct.pack("<QB", low, to) + tail, (x - x.dtype.type(low)).astype(f"<u{to}").tobytes())

    def decode(data):
        header, body = unframed(data)
        low, to = struct.unpack_from("<QB", header)
        x = np.frombuffer(body, f"<u{to}").astype(f"<u{width}")
        return (x + x.dtype.type(low)).tobytes() + header[9:]

    return Node(f"range_pack{8 * width}", encode, decode)


def tokenize(width: int) -> Node:
    """Sorted alphabet in the header, narrow indices in the body."""

    def encode(data):
        x, tail = split_ints(data, width)
        alphabet, index = np.unique(x, return_inverse=True)
        to = narrowest(max(len(alphabet) - 1, 0))
        return framed(struct.pack("<IB", len(alphabet), to) + alphabet.tobytes() + tail, index.astype(f"<u{to}").tobytes())

    def decode(data):
        header, body = unframed(data)
        n, to = struct.unpack_from("<IB", header)
        alphabet = np.frombuffer(header, f"<u{width}", n, 5)
        index = np.frombuffer(body, f"<u{to}")
        return (alphabet[index].tobytes() if n else b"") + header[5 + n * width :]

    return Node(f"tokenize{8 * width}", encode, decode)


def transpose(width: int) -> Node:
    def encode(data):
        n = len(data) // width * width
        return framed(data[n:], np.frombuffer(data[:n], np.uint8).reshape(-1, width).T.tobytes())

    def decode(data):
        tail, body = unframed(data)
        return np.frombuffer(body, np.uint8).reshape(width, -1).T.tobytes() + tail

    return Node(f"transpose{8 * width}", encode, decode)


def pack_bits(x: np.ndarray, bits: int) -> bytes:
    each = (x[:, None] >> np.arange(bits).astype(x.dtype)) & x.dtype.type(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=bits * n, bitorder="little").reshape(n, bits).astype(np.uint64)
    return (each << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def bit_pack(width: int) -> Node:
    def encode(data):
        x, tail = split_ints(data, width)
        bits = max(int(x.max()).bit_length(), 1) if len(x) else 1
        return framed(struct.pack("<IB", len(x), bits) + tail, pack_bits(x, bits))

    def decode(data):
        header, body = unframed(data)
        n, bits = struct.unpack_from("<IB", header)
        return unpack_bits(body, bits, n).astype(f"<u{width}").tobytes() + header[5:]

    return Node(f"bitpack{8 * width}", encode, decode)


def flat_encode(data):
    alphabet, index = np.unique(np.frombuffer(data, np.uint8), return_inverse=True)
    bits = max(int(len(alphabet) - 1).bit_length(), 1)
    return framed(struct.pack("<IB", len(data), bits) + alphabet.tobytes(), pack_bits(index.astype(np.uint64), bits) if len(data) else b"")


def flat_decode(data):
    header, body = unframed(data)
    n, bits = struct.unpack_from("<IB", header)
    alphabet = np.frombuffer(header[5:], np.uint8)
    return alphabet[unpack_bits(body, bits, n).astype(np.int64)].tobytes() if n else b""


def constant_encode(data):
    if len(set(data)) != 1:
        raise ValueError("not constant")
    return data[:1] + struct.pack("<Q", len(data))


def constant_decode(data):
    return data[:1] * struct.unpack_from("<Q", data, 1)[0]


def lz_encode(data: bytes, least: int = 4) -> bytes:
    """Greedy matches by a table of the last place of each `least` bytes: literals, then literal lengths, match lengths and
    offsets, as streams of their own."""
    seen: dict[bytes, int] = {}
    literals, counts, lengths, offsets = bytearray(), [], [], []
    at = start = 0
    while at + least <= len(data):
        key = data[at : at + least]
        from_ = seen.get(key)
        seen[key] = at
        if from_ is None:
            at += 1
            continue
        n = least
        while at + n < len(data) and data[from_ + n] == data[at + n]:
            n += 1
        literals += data[start:at]
        counts.append(at - start)
        lengths.append(n)
        offsets.append(at - from_)
        at += n
        start = at
    literals += data[start:]
    streams = [np.array(x, "<u4").tobytes() for x in (counts, lengths, offsets)]
    return framed(struct.pack("<I", len(counts)), b"".join(streams) + bytes(literals))


def lz_decode(data: bytes) -> bytes:
    header, body = unframed(data)
    n = struct.unpack("<I", header)[0]
    counts, lengths, offsets = (np.frombuffer(body, "<u4", n, 4 * n * i).tolist() for i in range(3))
    literals, at, out = body[12 * n :], 0, bytearray()
    for c, m, o in zip(counts, lengths, offsets):
        out += literals[at : at + c]
        at += c
        for _ in range(m) if o < m else ():
            out.append(out[-o])
        if o >= m:
            out += out[len(out) - o : len(out) - o + m]
    return bytes(out + literals[at:])


def field_lz(width: int) -> Node:
    """Matches of two elements or more, element by element: literal counts, match lengths and distances in elements, then literals
    by their bytes (all first bytes, all second ones, ...), each stream packed on its own."""

    def encode(data):
        x, tail = split_ints(data, width)
        values = x.tolist()
        seen: dict[tuple, int] = {}
        kept, counts, lengths, distances = [], [], [], []
        at = begin = 0
        while at + 2 <= len(values):
            key = (values[at], values[at + 1])
            from_ = seen.get(key)
            seen[key] = at
            if from_ is None:
                at += 1
                continue
            n = 2
            while at + n < len(values) and values[from_ + n] == values[at + n]:
                n += 1
            kept += values[begin:at]
            counts.append(at - begin)
            lengths.append(n)
            distances.append(at - from_)
            at += n
            begin = at
        kept += values[begin:]
        literals = transpose(width).encode(np.array(kept, f"<u{width}").tobytes())
        streams = [zstd_encode(s) for s in (*(np.array(c, "<u4").tobytes() for c in (counts, lengths, distances)), literals)]
        return framed(tail, struct.pack("<4I", *map(len, streams)) + b"".join(streams))

    def decode(data):
        tail, body = unframed(data)
        at, streams = 16, []
        for n in struct.unpack_from("<4I", body):
            streams.append(zstd_decode(body[at : at + n]))
            at += n
        counts, lengths, distances = (np.frombuffer(s, "<u4").tolist() for s in streams[:3])
        kept, at, out = np.frombuffer(transpose(width).decode(streams[3]), f"<u{width}").tolist(), 0, []
        for c, n, d in zip(counts, lengths, distances):
            out += kept[at : at + c]
            at += c
            for _ in range(n):
                out.append(out[-d])
        return np.array(out + kept[at:], f"<u{width}").tobytes() + tail

    return Node(f"field_lz{8 * width}", encode, decode)


def partition_bitpack(width: int) -> Node:
    """The number of bits of each integer (a Huffman code of bytes), then what follows the highest bit, in just so many bits."""

    def encode(data):
        x, tail = split_ints(data, width)
        values = x.tolist()
        bits = np.array([v.bit_length() for v in values], np.uint8)
        rest = np.array([v >> i & 1 for v in values for i in range(v.bit_length() - 1)], np.uint8)
        head = huffman.encode(bits.tobytes())
        return framed(struct.pack("<I", len(head)) + head + tail, np.packbits(rest, bitorder="little").tobytes())

    def decode(data):
        header, body = unframed(data)
        n = struct.unpack_from("<I", header)[0]
        bits, rest = huffman.decode(header[4 : 4 + n]), np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little").tolist()
        out, at = [], 0
        for k in bits:
            out.append(sum(b << i for i, b in enumerate(rest[at : at + k - 1])) | 1 << k - 1 if k else 0)
            at += max(k - 1, 0)
        return np.array(out, f"<u{width}").tobytes() + header[4 + n :]

    return Node(f"partition_bitpack{8 * width}", encode, decode)


def zstd_encode(data):
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def zstd_decode(data):
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)


PLAIN = {
    "store": Node("store", bytes, bytes), "constant": Node("constant", constant_encode, constant_decode), "flatpack": Node("flatpack", flat_encode, flat_decode),
    "lz": Node("lz", lz_encode, lz_decode), "huffman": Node("huffman", huffman.encode, huffman.decode), "zstd": Node("zstd", zstd_encode, zstd_decode),
    "deflate": Node("deflate", lambda d: zlib.compress(d, 6), zlib.decompress), "lz4": Node("lz4", lambda d: struct.pack("<I", len(d)) + bytes(pa.Codec("lz4_raw").compress(d)), lambda d: bytes(pa.Codec("lz4_raw").decompress(d[4:], struct.unpack_from("<I", d)[0]))),
}
PLAIN |= {name: Node(name, *pair) for name, pair in {**MORE, **CODERS}.items()}
SIZED = {"field_lz": field_lz, "partition_bitpack": partition_bitpack, "delta": delta, "zigzag": zigzag, "range_pack": range_pack, "tokenize": tokenize, "transpose": transpose, "bitpack": bit_pack}


@functools.lru_cache(maxsize=None)
def node(name: str) -> Node:
    if name in PLAIN:
        return PLAIN[name]
    kind = name.rstrip("0123456789")  # nodes of a width end in its bits
    return SIZED[kind](int(name[len(kind) :]) // 8)


def encode(data: bytes, graph: tuple[str, ...]) -> bytes:
    for n in graph:
        data = node(n).encode(data)
    return data


def decode(data: bytes, graph: tuple[str, ...]) -> bytes:
    for n in reversed(graph):
        data = node(n).decode(data)
    return data


#: named graphs over bytes and over integers of a width
GRAPHS: dict[str, tuple[str, ...]] = {"store": ("store",), "constant": ("constant",), "flatpack": ("flatpack",), "bitpack": ("bitpack8",), "zstd": ("zstd",), "lz4": ("lz4",), "lz": ("lz", "zstd"), "delta_zstd": ("delta8", "zstd"), "delta_flatpack": ("delta8", "flatpack"), "huffman": ("huffman",), "delta_huffman": ("delta8", "huffman")}
GRAPHS |= {name: (name,) for name in CODERS}
for _w in (8, 16, 32, 64):
    GRAPHS |= {f"num{_w}": (f"transpose{_w}", "zstd"), f"num{_w}_delta": (f"delta{_w}", f"zigzag{_w}", f"transpose{_w}", "zstd"), f"num{_w}_range_pack": (f"range_pack{_w}", "zstd"), f"num{_w}_tokenize": (f"tokenize{_w}", "zstd"), f"num{_w}_bitpack": (f"bitpack{_w}",)}
    GRAPHS |= {f"field_lz{_w}": (f"field_lz{_w}",), f"delta{_w}_field_lz": (f"delta{_w}", f"field_lz{_w}"), f"tokenize{_w}_delta_field_lz": (f"tokenize{_w}", f"delta{_w}", f"field_lz{_w}"), f"partition_bitpack{_w}": (f"partition_bitpack{_w}",)}


#: what a selector tries by itself: every named graph, the adaptive coders as well
TRIED = GRAPHS


def smallest(data: list[bytes], todo: dict[str, tuple[str, ...]]) -> list[tuple[str, bytes]]:
    """Of each block the graph with the smallest result, and that result. Graphs of one entropy coder take all blocks at once."""
    best: list[tuple[str, bytes] | None] = [None] * len(data)
    for name, graph in todo.items():
        together = MANY[graph[0]][0](data) if len(graph) == 1 and graph[0] in MANY else None
        for i, x in enumerate(data):
            try:
                made = encode(x, graph) if together is None else together[i]
            except ValueError:
                continue
            if best[i] is None or len(made) < len(best[i][1]):
                best[i] = name, made
    return best


def undone(results: list[tuple[str, bytes]], todo: dict[str, tuple[str, ...]]) -> list[bytes]:
    """The blocks of such results, from what is stored alone. Those of one entropy coder are decoded together."""
    places: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(results):
        places.setdefault(name, []).append(i)
    out = [b""] * len(results)
    for name, at in places.items():
        graph, made = todo[name], [results[i][1] for i in at]
        together = len(graph) == 1 and graph[0] in MANY
        for i, x in zip(at, MANY[graph[0]][1](made) if together else [decode(y, graph) for y in made]):
            out[i] = x
    return out


def chosen(data: list[bytes], todo: dict[str, tuple[str, ...]]) -> list[tuple[str, int, int, bool]]:
    """Of each block the graph, the block's size, the result's, and whether it gives the block back. Equal blocks are encoded once."""
    once = list(dict.fromkeys(data))
    results = smallest(once, todo)
    known = {x: (name, len(x), len(made), x == y) for x, (name, made), y in zip(once, results, undone(results, todo))}
    return [known[x] for x in data]


def try_all(blocks: DataFrame, graphs: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """id, chunk_id, graph, n, size, restored: the smallest result of each block over all graphs (without a list: all named ones).
    A graph that cannot express a block (`constant`, where bytes differ) has no result of it. A null block is coded as an empty one; its n is null."""
    todo = graphs or TRIED

    def run(batches):
        for b in batches:
            data = b.column("bytes").to_pylist()
            rows = [(name, n if x is not None else None, *rest) for x, (name, n, *rest) in zip(data, chosen([x or b"" for x in data], todo))]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("chunk_id"), *columns], names=["id", "chunk_id", "graph", "n", "size", "restored"])

    rows = blocks.select(F.col("id").cast("long"), F.col("chunk_id").cast("long"), F.col("bytes").cast("binary"))
    return spread(rows, "id", "chunk_id").mapInArrow(run, "id long, chunk_id long, graph string, n long, size long, restored boolean")


def mapped(blocks: DataFrame, change: Callable[[bytes], bytes]) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("chunk_id"), pa.array([change(x or b"") for x in b.column("bytes").to_pylist()], pa.binary())], names=["id", "chunk_id", "bytes"])

    return blocks.select(F.col("id").cast("long"), F.col("chunk_id").cast("long"), F.col("bytes").cast("binary")).mapInArrow(run, "id long, chunk_id long, bytes binary")


def stored(blocks: DataFrame, graph: tuple[str, ...]) -> DataFrame:
    """id, chunk_id, bytes that the graph makes of each block."""
    return mapped(spread(blocks, "id", "chunk_id"), lambda x: encode(x, graph))


def restored(made: DataFrame, graph: tuple[str, ...]) -> DataFrame:
    """id, chunk_id, bytes of the blocks, from what is stored alone."""
    return mapped(made, lambda x: decode(x, graph))


def train_dictionary(samples: DataFrame, size: int = 16384, rows: int = 2000) -> bytes:
    """A zstd dictionary from a bounded sample of blobs (column bytes): the `rows` ones with the smallest hashes."""
    import zstandard

    some = samples.select("bytes", F.xxhash64("bytes").alias("h")).orderBy("h").limit(rows).collect()
    return zstandard.train_dictionary(size, [bytes(r["bytes"]) for r in some]).as_bytes()


def with_dictionary(blobs: DataFrame, dictionary: bytes) -> DataFrame:
    """id, plain and trained sizes of each blob, and whether it came back. The dictionary is of bounded size."""
    shared = blobs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        import zstandard

        d = zstandard.ZstdCompressionDict(shared.value)
        plain, pack, unpack = zstandard.ZstdCompressor(), zstandard.ZstdCompressor(dict_data=d), zstandard.ZstdDecompressor(dict_data=d)
        for b in batches:
            data = [x or b"" for x in b.column("bytes").to_pylist()]
            made = [pack.compress(x) for x in data]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(plain.compress(x)) for x in data], pa.int64()), pa.array([len(m) for m in made], pa.int64()), pa.array([unpack.decompress(m, max_output_size=max(len(x), 1)) == x for m, x in zip(made, data)])], names=["id", "plain", "trained", "restored"])

    return blobs.select(F.col("id").cast("long"), F.col("bytes").cast("binary")).mapInArrow(run, "id long, plain long, trained long, restored boolean")


@dataclass(frozen=True)
class Tree:
    """A binary decision tree: feature index (-1: a leaf), threshold or leaf value, children; `missing` where a value is NaN."""

    feature: tuple[int, ...]
    value: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    missing: tuple[int, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, value, left, right, missing = (np.array(c) for c in (self.feature, self.value, self.left, self.right, self.missing))
        while (live := feature[at] >= 0).any():
            rows = np.flatnonzero(live)
            here = at[rows]
            v = x[rows, feature[here]]
            at[rows] = np.where(np.isnan(v), missing[here], np.where(v < value[here], left[here], right[here]))
        return value[at]


def forest_choice(features: DataFrame, columns: list[str], forests: list[list[Tree]], labels: list[str]) -> DataFrame:
    """The label of the forest with the largest sum of trees; a single forest is compared with 0 (labels: below, above)."""
    other = [c for c in features.columns if c not in columns]

    def run(batches):
        for b in batches:
            x = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1)
            sums = np.stack([sum(t.score(x) for t in f) for f in forests], 1)
            pick = (sums[:, 0] > 0).astype(int) if len(forests) == 1 else sums.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in other), pa.array([labels[i] for i in pick], pa.string())], names=[*other, "label"])

    schema = ", ".join(f"`{c}` {features.schema[c].dataType.simpleString()}" for c in other)
    return features.mapInArrow(run, schema + ", label string")
