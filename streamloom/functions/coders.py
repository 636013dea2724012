"""Entropy coders of byte blocks, each with its inverse: state machines over normalised counts (one table, or one for each preceding
byte), arithmetic codes with static counts, and binary arithmetic codes with adaptive contexts, alone or mixed.

All formats are this module's own. A block begins with its length (4 bytes, lowest first). A task holds one block at a time; coders
go symbol by symbol, so blocks are meant to be small. Arithmetic is in integers only: what one machine codes, any other decodes.
"""

from __future__ import annotations

import numpy as np

LOG = 11


def normalised(counts: np.ndarray, log: int = LOG) -> np.ndarray:
    """Counts scaled to a sum of 2 ** log; what occurs keeps at least 1. Rounding errors go to the most frequent symbols."""
    counts = np.asarray(counts, np.int64)
    total, size = int(counts.sum()), 1 << log
    if not total:
        return np.zeros(len(counts), np.int64)
    if (counts > 0).sum() > size:
        raise ValueError("more symbols than states")
    out = np.where(counts > 0, np.maximum(counts * size // total, 1), 0)
    left = size - int(out.sum())
    by = np.argsort(-counts, kind="stable").tolist()
    while left:
        for s in by:
            if left > 0 and out[s]:
                out[s] += 1
                left -= 1
            elif left < 0 and out[s] > 1:
                out[s] -= 1
                left += 1
            if not left:
                break
    return out


class Bits:
    """Bits in order, highest of a number first."""

    def __init__(self, data: bytes = b""):
        self.out: list[int] = []
        self.given = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def put(self, value: int, n: int) -> None:
        self.out += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def get(self, n: int) -> int:
        x = 0
        for i in range(self.at, self.at + n):
            x = x << 1 | (self.given[i] if i < len(self.given) else 0)
        self.at += n
        return x

    def bytes(self) -> bytes:
        return np.packbits(np.array(self.out, np.uint8)).tobytes()


def pack_counts(norm: np.ndarray) -> bytes:
    """Normalised counts: each as an Elias gamma code of itself plus 1, a run of zeros as a zero's code and the run's length."""
    bits, i, x = Bits(), 0, [int(c) for c in norm]

    def gamma(v):
        bits.put(0, v.bit_length() - 1)
        bits.put(v, v.bit_length())

    while i < len(x):
        gamma(x[i] + 1)
        if x[i]:
            i += 1
            continue
        j = i
        while j < len(x) and x[j] == 0:
            j += 1
        gamma(j - i)
        i = j
    return bits.bytes()


def unpack_counts(data: bytes, symbols: int = 256) -> tuple[np.ndarray, int]:
    """The counts, and how many bytes they took."""
    bits, out = Bits(data), []

    def gamma():
        n = 0
        while bits.at < len(bits.given) and bits.get(1) == 0:
            n += 1
        return 1 << n | bits.get(n)

    while len(out) < symbols:
        c = gamma() - 1
        out += [c] if c else [0] * gamma()
    return np.array(out[:symbols], np.int64), -(-bits.at // 8)


def states(norm: np.ndarray) -> tuple[list[int], dict[int, list[int]]]:
    """The symbol of each state, and the states of each symbol in order: a symbol's states lie at even distances."""
    owner = np.repeat(np.arange(len(norm)), norm)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(norm) - norm, norm)
    order = np.lexsort((owner, (2 * j + 1) * (1 << 40) // (2 * norm[owner])))
    symbol = owner[order].tolist()
    places: dict[int, list[int]] = {}
    for at, s in enumerate(symbol):
        places.setdefault(s, []).append(at)
    return symbol, places


def fse(data: bytes) -> bytes:
    """A table of states over normalised counts; the state carries fractions of bits from symbol to symbol."""
    head = len(data).to_bytes(4, "little")
    if not data:
        return head
    norm = normalised(np.bincount(np.frombuffer(data, np.uint8), minlength=256))
    _, places = states(norm)
    size, x, written = 1 << LOG, 1 << LOG, []
    for c in reversed(data):
        q = int(norm[c])
        n = max(x.bit_length() - (2 * q - 1).bit_length(), 0)
        if x >> n >= 2 * q:
            n += 1
        written.append((x & ((1 << n) - 1), n))
        x = size + places[c][(x >> n) - q]
    bits = Bits()
    bits.put(x - size, LOG)
    for v, n in reversed(written):
        bits.put(v, n)
    return head + pack_counts(norm) + bits.bytes()


def undo_fse(stored: bytes) -> bytes:
    n = int.from_bytes(stored[:4], "little")
    if not n:
        return b""
    norm, used = unpack_counts(stored[4:])
    symbol, places = states(norm)
    nth = [0] * len(symbol)
    for s, at in places.items():
        for k, p in enumerate(at):
            nth[p] = int(norm[s]) + k
    bits, size, out = Bits(stored[4 + used :]), 1 << LOG, bytearray()
    x = size + bits.get(LOG)
    for _ in range(n):
        out.append(symbol[x - size])
        y = nth[x - size]
        k = LOG + 1 - y.bit_length()
        x = y << k | bits.get(k)
    return bytes(out)


def tables(data: bytes, order: int) -> dict[int, np.ndarray]:
    """Normalised counts by context: the preceding byte (0 at the start), or one for all."""
    x = np.frombuffer(data, np.uint8)
    if not order:
        return {0: normalised(np.bincount(x, minlength=256))}
    before = np.concatenate([[0], x[:-1]]).astype(np.uint8)
    return {int(c): normalised(np.bincount(x[before == c], minlength=256)) for c in np.unique(before)}


def starts(norm: np.ndarray) -> list[int]:
    return np.concatenate([[0], np.cumsum(norm)]).tolist()


def packed_tables(norms: dict[int, np.ndarray]) -> bytes:
    return bytes([len(norms) - 1]) + b"".join(bytes([c]) + pack_counts(n) for c, n in sorted(norms.items()))


def unpacked_tables(data: bytes, at: int) -> tuple[dict[int, np.ndarray], int]:
    out, n = {}, data[at] + 1
    at += 1
    for _ in range(n):
        c = data[at]
        out[c], used = unpack_counts(data[at + 1 :])
        at += 1 + used
    return out, at


LOW = 1 << 23


def ans(data: bytes, order: int = 0) -> bytes:
    """Range variant of asymmetric numeral systems, a byte at a time; order 1 has a table for each preceding byte."""
    head = len(data).to_bytes(4, "little")
    if not data:
        return head
    norms = tables(data, order)
    begin = {c: starts(n) for c, n in norms.items()}
    x, out = LOW, bytearray()
    for i in range(len(data) - 1, -1, -1):
        c = (data[i - 1] if i else 0) if order else 0
        f = int(norms[c][data[i]])
        while x >= (LOW >> LOG << 8) * f:
            out.append(x & 255)
            x >>= 8
        x = (x // f << LOG) + x % f + begin[c][data[i]]
    return head + packed_tables(norms) + x.to_bytes(4, "little") + bytes(reversed(out))


def undo_ans(stored: bytes, order: int = 0) -> bytes:
    n = int.from_bytes(stored[:4], "little")
    if not n:
        return b""
    norms, at = unpacked_tables(stored, 4)
    begin = {c: starts(t) for c, t in norms.items()}
    owner = {c: np.repeat(np.arange(256), t).tolist() for c, t in norms.items()}
    x, at, out, c = int.from_bytes(stored[at : at + 4], "little"), at + 4, bytearray(), 0
    for _ in range(n):
        low = x & ((1 << LOG) - 1)
        s = owner[c][low]
        out.append(s)
        x = int(norms[c][s]) * (x >> LOG) + low - begin[c][s]
        while x < LOW:
            x, at = x << 8 | stored[at], at + 1
        c = s if order else 0
    return bytes(out)


HALF, QUARTER = 1 << 31, 1 << 30


class Arithmetic:
    """Intervals of 32 bits that narrow to (low, high) of a total; straddling intervals count bits that follow later."""

    def __init__(self, data: bytes | None = None):
        self.low, self.high, self.later, self.bits = 0, (1 << 32) - 1, 0, Bits(data or b"")
        self.code = 0 if data is None else self.bits.get(32)

    def emit(self, bit: int) -> None:
        self.bits.out += [bit] + [1 - bit] * self.later
        self.later = 0

    def narrow(self, low: int, high: int, total: int, coding: bool) -> None:
        width = self.high - self.low + 1
        self.low, self.high = self.low + width * low // total, self.low + width * high // total - 1
        while True:
            if self.high < HALF:
                drop = 0
                if coding:
                    self.emit(0)
            elif self.low >= HALF:
                drop = HALF
                if coding:
                    self.emit(1)
            elif self.low >= QUARTER and self.high < HALF + QUARTER:
                drop = QUARTER
                self.later += coding
            else:
                return
            self.low, self.high = (self.low - drop) << 1, (self.high - drop) << 1 | 1
            if not coding:
                self.code = (self.code - drop) << 1 | self.bits.get(1)

    def target(self, total: int) -> int:
        return ((self.code - self.low + 1) * total - 1) // (self.high - self.low + 1)

    def done(self) -> bytes:
        self.later += 1
        self.emit(int(self.low >= QUARTER))
        return self.bits.bytes()


def ranged(data: bytes) -> bytes:
    """Arithmetic code of order 0 with static counts."""
    head = len(data).to_bytes(4, "little")
    if not data:
        return head
    norm = tables(data, 0)[0]
    begin, coder = starts(norm), Arithmetic()
    for c in data:
        coder.narrow(begin[c], begin[c + 1], 1 << LOG, True)
    return head + pack_counts(norm) + coder.done()


def undo_ranged(stored: bytes) -> bytes:
    n = int.from_bytes(stored[:4], "little")
    if not n:
        return b""
    norm, used = unpack_counts(stored[4:])
    begin, owner = starts(norm), np.repeat(np.arange(256), norm).tolist()
    coder, out = Arithmetic(stored[4 + used :]), bytearray()
    for _ in range(n):
        s = owner[coder.target(1 << LOG)]
        out.append(s)
        coder.narrow(begin[s], begin[s + 1], 1 << LOG, False)
    return bytes(out)


ONE = 1 << 12


def squash(x: int) -> int:
    """2 ** 12 / (1 + exp(-x / 256)) by straight lines between powers of two, for x in -2047 to 2047."""
    x = max(min(x, 2047), -2047)
    y = abs(x)
    k, rest = divmod(y, 177)  # 256 * ln 2
    tail = (ONE // 2 >> k) - ((ONE // 2 >> k) - (ONE // 2 >> k + 1)) * rest // 177
    return max(tail, 1) if x < 0 else min(ONE - tail, ONE - 1)


def inverse_of_squash() -> list[int]:
    out, x = [], -2047
    for p in range(ONE):
        while x < 2047 and squash(x) < p:
            x += 1
        out.append(x)
    return out


STRETCH = inverse_of_squash()


class Mixture:
    """The probability of the next bit, from the bits of the byte so far after the last bytes (one model for each order),
    weighed in the logistic domain. A single order is taken as it is."""

    def __init__(self, orders: tuple[int, ...]):
        self.orders, self.models = orders, [{} for _ in orders]
        self.weights = [(1 << 16) // len(orders)] * len(orders)
        self.past, self.node = b"", 1

    def predict(self) -> int:
        self.keys = [(self.past[len(self.past) - o :] if o else b"", self.node) for o in self.orders]
        self.seen = [m.get(k, (ONE // 2, 0)) for m, k in zip(self.models, self.keys)]
        if len(self.orders) == 1:
            self.p = self.seen[0][0]
        else:
            self.stretched = [STRETCH[p] for p, _ in self.seen]
            self.p = squash(sum(w * s for w, s in zip(self.weights, self.stretched)) >> 16)
        self.p = max(min(self.p, ONE - 1), 1)
        return self.p

    def learn(self, bit: int) -> None:
        wrong = (bit << 12) - self.p
        if len(self.orders) > 1:
            self.weights = [w + (s * wrong >> 10) for w, s in zip(self.weights, self.stretched)]
        for m, k, (p, n) in zip(self.models, self.keys, self.seen):
            m[k] = p + ((bit << 12) - p) // (n + 2), min(n + 1, 30)
        self.node = self.node << 1 | bit
        if self.node >= 256:
            self.past, self.node = (self.past + bytes([self.node & 255]))[-max(self.orders, default=0) or len(self.past) + 1 :], 1


def adaptive(data: bytes, orders: tuple[int, ...] = (0,)) -> bytes:
    """Bits of each byte, highest first, coded by the mixture of orders."""
    coder, model = Arithmetic(), Mixture(orders)
    for c in data:
        for i in range(7, -1, -1):
            bit, p = c >> i & 1, model.predict()
            coder.narrow(*((0, p) if bit else (p, ONE)), ONE, True)
            model.learn(bit)
    return len(data).to_bytes(4, "little") + (coder.done() if data else b"")


def undo_adaptive(stored: bytes, orders: tuple[int, ...] = (0,)) -> bytes:
    n, model, out = int.from_bytes(stored[:4], "little"), Mixture(orders), bytearray()
    coder = Arithmetic(stored[4:])
    for _ in range(n):
        c = 0
        for _ in range(8):
            p = model.predict()
            bit = int(coder.target(ONE) < p)
            coder.narrow(*((0, p) if bit else (p, ONE)), ONE, False)
            model.learn(bit)
            c = c << 1 | bit
        out.append(c)
    return bytes(out)


#: orders of the contexts that the adaptive coders mix
MIXTURES: dict[str, tuple[int, ...]] = {"fpaq": (0,), "cm": (0, 1, 2), "paq": (1, 2, 3), "tpaq": (0, 1, 2, 3, 4), "tpaqx": (0, 1, 2, 3, 4, 6)}

CODERS = {
    "fse": (fse, undo_fse), "ans0": (ans, undo_ans), "ans1": (lambda d: ans(d, 1), lambda d: undo_ans(d, 1)), "range": (ranged, undo_ranged),
    **{name: (lambda d, o=orders: adaptive(d, o), lambda d, o=orders: undo_adaptive(d, o)) for name, orders in MIXTURES.items()},
}
