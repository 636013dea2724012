"""Canonical Huffman codes of byte blocks, with inverse.

A block is stored as its length (4 bytes, lowest first), 256 code lengths of a byte where it holds two symbols or more, or the one
symbol, and the codes, highest bit first. Codes of one length are in the order of their symbols.
"""

from __future__ import annotations

import heapq

import numpy as np


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Length of the code of each symbol that occurs (ties go to the symbol, or group, that was made first)."""
    heap = [(int(c), int(s), [int(s)]) for s, c in enumerate(counts) if c]
    lengths = np.zeros(len(counts), np.int64)
    heapq.heapify(heap)
    made = len(counts)
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        lengths[left + right] += 1
        heapq.heappush(heap, (a + b, made, left + right))
        made += 1
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes: counted up through symbols in the order of (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for s in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - last
        codes[s], last = code, int(lengths[s])
        code += 1
    return codes


def encode(data: bytes) -> bytes:
    x = np.frombuffer(data, np.uint8)
    head = len(x).to_bytes(4, "little")
    if not len(x):
        return head
    lengths = code_lengths(np.bincount(x, minlength=256))
    if not lengths.any():
        return head + data[:1]
    n = lengths[x]
    codes = canonical(lengths)[x]
    row = np.repeat(np.arange(len(x)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(row)) - 1  # bits of the code after this one
    return head + lengths.astype(np.uint8).tobytes() + np.packbits((codes[row] >> left) & 1).tobytes()


def decode(stored: bytes) -> bytes:
    n = int.from_bytes(stored[:4], "little")
    if n == 0:
        return b""
    if len(stored) == 5:
        return stored[4:] * n
    lengths = np.frombuffer(stored[4:260], np.uint8).astype(np.int64)
    codes = canonical(lengths)
    # by length: the first code, and the symbols in order
    by = {int(k): (int(codes[np.flatnonzero(lengths == k)].min()), np.flatnonzero(lengths == k).tolist()) for k in np.unique(lengths[lengths > 0])}
    out, code, size = bytearray(), 0, 0
    for bit in np.unpackbits(np.frombuffer(stored[260:], np.uint8)).tolist():
        code, size = code << 1 | bit, size + 1
        if size in by and 0 <= code - by[size][0] < len(by[size][1]):
            out.append(by[size][1][code - by[size][0]])
            code = size = 0
            if len(out) == n:
                break
    return bytes(out)
