"""Further reversible transforms of byte blocks: sorting without an index, ranks, matches against contexts, characters, call addresses.

One pure function each way, in formats of this module's own; blocks.TRANSFORMS has their names.
"""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np


def as_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def lyndon(data: bytes) -> list[int]:
    """Where the Lyndon words of the data end (Duval)."""
    ends, i, n = [], 0, len(data)
    while i < n:
        j, k = i + 1, i
        while j < n and data[k] <= data[j]:
            k = i if data[k] < data[j] else k + 1
            j += 1
        while i <= k:
            i += j - k
            ends.append(i)
    return ends


def bijective_sort(data: bytes) -> bytes:
    """The bytes before the rotations of all Lyndon words, sorted as words that repeat for ever; no index is needed."""
    if not data:
        return b""
    ends, b = np.array(lyndon(data)), as_bytes(data)
    begins = np.concatenate([[0], ends[:-1]])
    follow = np.arange(1, len(b) + 1)
    follow[ends - 1] = begins
    before = np.empty(len(b), np.int64)
    before[follow] = np.arange(len(b))
    rank, step, classes = b.astype(np.int64), follow, 0
    while True:
        second = rank[step]
        order = np.lexsort((second, rank))
        new = np.empty(len(b), np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)]))
        if new.max() + 1 == classes:
            return b[before[order]].tobytes()
        rank, step, classes = new, step[step], int(new.max()) + 1


def undo_bijective_sort(data: bytes) -> bytes:
    last = as_bytes(data)
    to = np.empty(len(last), np.int64)
    to[np.argsort(last, kind="stable")] = np.arange(len(last))
    seen, out, at = np.zeros(len(last), bool), bytearray(len(last)), len(last)
    for i in range(len(last)):
        j = i
        while not seen[j]:
            seen[j] = True
            at -= 1
            out[at] = last[j]
            j = to[j]
    return bytes(out)


def ranks(data: bytes, undo: bool = False) -> bytes:
    """A byte as its place in a list sorted by the mean of its last two times, the latest first."""
    table, times, key, out = list(range(256)), [0] * 256, [0] * 256, bytearray()
    for i, x in enumerate(data):
        at = x if undo else table.index(x)
        c = table.pop(at)
        out.append(c if undo else at)
        key[c], times[c] = (i + times[c]) // 2, i
        while at and key[table[at - 1]] <= key[c]:
            at -= 1
        table.insert(at, c)
    return bytes(out)


def undo_ranks(data: bytes) -> bytes:
    return ranks(data, undo=True)


ESCAPE = 0xFF
LEAST = 8


def predicted(data: bytes) -> bytes:
    """What follows the last place of the same 4 bytes, if 8 bytes or more agree: an escape and the length (up to 254 above 8)."""
    seen: dict[bytes, int] = {}
    out, at = bytearray(), 0
    while at < len(data):
        key = data[at - 4 : at] if at >= 4 else None
        from_ = seen.get(key) if key is not None else None
        if key is not None:
            seen[key] = at
        n = 0
        while from_ is not None and n < LEAST + 254 and at + n < len(data) and data[from_ + n] == data[at + n]:
            n += 1
        if n >= LEAST:
            out += bytes([ESCAPE, n - LEAST])
            at += n
        else:
            # an escape byte of the data goes with 255, which no match has
            out += bytes([ESCAPE, 255]) if data[at] == ESCAPE else data[at : at + 1]
            at += 1
    return bytes(out)


def undo_predicted(stored: bytes) -> bytes:
    seen: dict[bytes, int] = {}
    out, i = bytearray(), 0
    while i < len(stored):
        key = bytes(out[-4:]) if len(out) >= 4 else None
        from_ = seen.get(key) if key is not None else None
        if key is not None:
            seen[key] = len(out)
        if stored[i] != ESCAPE:
            out.append(stored[i])
            i += 1
        elif stored[i + 1] == 255:
            out.append(ESCAPE)
            i += 2
        else:
            for k in range(stored[i + 1] + LEAST):
                out.append(out[from_ + k])
            i += 2
    return bytes(out)


def reduced_offsets(data: bytes, context: int = 1, places: int = 16) -> bytes:
    """Matches named by their number among the last places of the same context, in place of an offset: literals, then flags of
    counts, numbers and lengths (4 bytes or more, up to 258) as streams of their own. A context of 2 bytes and more places search longer."""
    last: dict[bytes, list[int]] = {}
    literals, counts, numbers, lengths = bytearray(), [], bytearray(), bytearray()
    at = begin = 0
    while at < len(data):
        key = data[max(at - context, 0) : at]
        known = last.setdefault(key, [])
        best, which = 0, 0
        for k, p in enumerate(reversed(known)):
            n = 0
            while n < 258 and at + n < len(data) and data[p + n] == data[at + n]:
                n += 1
            if n > best:
                best, which = n, k
        known.append(at)
        del known[:-places]
        if best >= 4:
            literals += data[begin:at]
            counts.append(at - begin)
            numbers.append(which)
            lengths.append(best - 4)
            at += best
            begin = at
        else:
            at += 1
    literals += data[begin:]
    return struct.pack("<II", len(counts), len(literals)) + np.array(counts, "<u4").tobytes() + bytes(numbers) + bytes(lengths) + bytes(literals)


def undo_reduced_offsets(stored: bytes, context: int = 1, places: int = 16) -> bytes:
    n, size = struct.unpack_from("<II", stored)
    counts = np.frombuffer(stored, "<u4", n, 8).tolist()
    numbers, lengths, literals = stored[8 + 4 * n : 8 + 5 * n], stored[8 + 5 * n : 8 + 6 * n], stored[8 + 6 * n :]
    last: dict[bytes, list[int]] = {}
    out, at = bytearray(), 0

    def note():
        known = last.setdefault(bytes(out[max(len(out) - context, 0) :]), [])
        known.append(len(out))
        del known[:-places]

    for c, which, length in zip([*counts, size - sum(counts)], [*numbers, None], [*lengths, 0]):
        for x in literals[at : at + c]:
            note()
            out.append(x)
        at += c
        if which is not None:
            p = last[bytes(out[max(len(out) - context, 0) :])][-1 - which]
            note()
            for k in range(length + 4):
                out.append(out[p + k])
    return bytes(out)


def characters(data: bytes) -> bytes:
    """Characters of UTF-8 by falling frequency: the alphabet, then one byte for the first 128 and two for others (up to 32768 of them);
    else as it is."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return b"\x00" + data
    count = Counter(text)
    alphabet = sorted(count, key=lambda c: (-count[c], c))
    if len(alphabet) > 1 << 15:
        return b"\x00" + data
    code = {c: bytes([i]) if i < 128 else bytes([128 | i >> 8, i & 255]) for i, c in enumerate(alphabet)}
    head = "".join(alphabet).encode()
    return b"\x01" + struct.pack("<I", len(head)) + head + b"".join(code[c] for c in text)


def undo_characters(stored: bytes) -> bytes:
    if stored[:1] != b"\x01":
        return stored[1:]
    n = struct.unpack_from("<I", stored, 1)[0]
    alphabet, out, i = stored[5 : 5 + n].decode(), [], 5 + n
    while i < len(stored):
        wide = stored[i] >= 128
        out.append(alphabet[(stored[i] & 127) << 8 | stored[i + 1]] if wide else alphabet[stored[i]])
        i += 1 + wide
    return "".join(out).encode()


#: fixed values: the four bases
BASES = b"ACGT"


def bases(data: bytes) -> bytes:
    """Four bases to a byte; other bytes count as the first base, and their places and values stand in the header."""
    b = as_bytes(data)
    code = np.full(256, 255, np.uint8)
    code[as_bytes(BASES)] = np.arange(4)
    x = code[b]
    odd = np.flatnonzero(x == 255)
    x = np.concatenate([np.where(x == 255, 0, x), np.zeros(-len(x) % 4, np.uint8)]).reshape(-1, 4)
    packed = (x << np.arange(0, 8, 2)).sum(axis=1).astype(np.uint8)
    return struct.pack("<II", len(b), len(odd)) + odd.astype("<u4").tobytes() + b[odd].tobytes() + packed.tobytes()


def undo_bases(stored: bytes) -> bytes:
    n, k = struct.unpack_from("<II", stored)
    odd, values = np.frombuffer(stored, "<u4", k, 8), as_bytes(stored[8 + 4 * k : 8 + 5 * k])
    packed = as_bytes(stored[8 + 5 * k :])
    out = as_bytes(BASES)[((packed[:, None] >> np.arange(0, 8, 2)) & 3).ravel()[:n]].copy()
    out[odd] = values
    return out.tobytes()


def calls(data: bytes, undo: bool = False) -> bytes:
    """Relative targets of x86 calls and jumps (E8, E9), whose highest byte is 00 or FF, as absolute ones modulo 2 ** 25, and back."""
    out, i = bytearray(data), 0
    while i + 5 <= len(out):
        if out[i] not in (0xE8, 0xE9):
            i += 1
            continue
        if out[i + 4] in (0, 255):
            target = int.from_bytes(out[i + 1 : i + 5], "little") + (-(i + 5) if undo else i + 5)
            target &= (1 << 25) - 1
            if target >> 24:
                target |= 0xFF000000
            out[i + 1 : i + 5] = target.to_bytes(4, "little")
        i += 5  # changed or not: the way back meets the same instructions
    return bytes(out)


#: fixed values: byte order of the instructions, mask and value of the branch-and-link instruction, bits of its target and their shift
BRANCHES = {"arm": ("<u4", 0xFF000000, 0xEB000000, 24, 0), "arm64": ("<u4", 0xFC000000, 0x94000000, 26, 0), "ppc": (">u4", 0xFC000003, 0x48000001, 24, 2)}


def branches(data: bytes, machine: str, undo: bool = False) -> bytes:
    """Relative targets of branch-and-link instructions as absolute ones, and back; what does not fill an instruction stays."""
    kind, mask, value, bits, shift = BRANCHES[machine]
    n = len(data) // 4 * 4
    x = np.frombuffer(data[:n], kind).astype(np.int64)
    here = np.arange(len(x), dtype=np.int64)
    target = (((x >> shift) + (-here if undo else here)) & ((1 << bits) - 1)) << shift
    return np.where((x & mask) == value, x & ~(((1 << bits) - 1) << shift) | target, x).astype(kind).tobytes() + data[n:]


#: words of the dictionary transform: the most frequent ones of a block, of this length or longer
WORD = 3


def words(data: bytes, most: int = 128) -> bytes:
    """Words of letters that come again as an escape (FF) and their number; a byte of the data that is FF goes as FF FF."""
    import re

    found = Counter(re.findall(rb"[A-Za-z]{%d,}" % WORD, data))
    gain = sorted((w for w, c in found.items() if (c - 1) * (len(w) - 2) > 2), key=lambda w: (-found[w] * (len(w) - 2), w))[:most]
    number = {w: bytes([ESCAPE, i]) for i, w in enumerate(gain)}
    body = re.sub(rb"[A-Za-z]{%d,}|\xff" % WORD, lambda m: number.get(m[0], m[0]) if m[0] != b"\xff" else b"\xff\xff", data)
    head = b" ".join(gain)
    return struct.pack("<I", len(head)) + head + body


def undo_words(stored: bytes) -> bytes:
    import re

    n = struct.unpack_from("<I", stored)[0]
    gain = stored[4 : 4 + n].split(b" ")
    return re.sub(rb"\xff(.)", lambda m: b"\xff" if m[1] == b"\xff" else gain[m[1][0]], stored[4 + n :], flags=re.S)


MORE = {
    "bwts": (bijective_sort, undo_bijective_sort), "rank": (ranks, undo_ranks), "lzp": (predicted, undo_predicted), "rolz": (reduced_offsets, undo_reduced_offsets),
    "rolzx": (lambda d: reduced_offsets(d, 2, 64), lambda d: undo_reduced_offsets(d, 2, 64)), "utf": (characters, undo_characters), "dna": (bases, undo_bases),
    "exe": (calls, lambda d: calls(d, undo=True)), "dict": (words, undo_words),
    **{m: (lambda d, m=m: branches(d, m), lambda d, m=m: branches(d, m, undo=True)) for m in BRANCHES},
}
