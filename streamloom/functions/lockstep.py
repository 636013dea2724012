"""The entropy coders of `coders` over many blocks at once: the same bytes, symbol by symbol, but a step goes through all blocks in
numpy. Blocks are sorted by falling length, so those that still run are the first ones; a round takes as many as fit LANES and ROOM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from streamloom.functions.coders import CODERS, HALF, LOG, LOW, MIXTURES, ONE, STRETCH, squash

LANES, ROOM = 1024, 48 << 20
SIZE = 1 << LOG


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


class Lanes:
    """Blocks as rows of a matrix, longest first; live[t]: how many have more than t bytes."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.steps = int(lengths[0]) if len(lengths) else 0
        self.live = np.searchsorted(-lengths, -np.arange(self.steps), side="left").tolist()

    def matrix(self, data: list[bytes], room: int = 0) -> np.ndarray:
        """Rows of bytes, with `room` zeros or more after each."""
        sizes = np.array([len(x) for x in data])
        out = np.zeros((len(data), int(sizes.max(initial=0)) + room), np.uint8)
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(data), np.uint8)
        return out


def pieces(flat: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def packed(row: np.ndarray, n: np.ndarray, v: np.ndarray, rows: int) -> list[bytes]:
    """Bits of each row: records in their order, rows in theirs; the n (24 at most) low bits of v, highest first."""
    total = np.bincount(row, n, rows).astype(np.int64)
    sizes = -(-total // 8)
    begin = np.cumsum(sizes) - sizes
    at = np.cumsum(n) - n - np.repeat(np.cumsum(total) - total, np.bincount(row, minlength=rows))
    place, word = begin[row] + (at >> 3), v << (32 - (at & 7) - n)
    out = np.zeros(int(sizes.sum()) + 4)
    for i in range(4):
        out += np.bincount(place + i, word >> (24 - 8 * i) & 255, len(out))[: len(out)]
    return pieces(out[: int(sizes.sum())].astype(np.uint8).tobytes(), sizes)


class Window:
    """Reads up to 32 bits at a place of each row."""

    def __init__(self, data: np.ndarray):
        # data has 8 zeros or more after each row
        self.width = data.shape[1] - 7
        words = np.zeros((len(data), self.width), np.uint64)
        for i in range(8):
            words |= data[:, i : i + self.width].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.words = words.ravel()

    def get(self, lane: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        word = self.words[lane * self.width + np.minimum(at >> 3, self.width - 1)]
        return (word << (at & 7).astype(np.uint64) >> np.uint64(32) >> (32 - n).astype(np.uint64)).astype(np.int64)


# -- counts --


def normalised(group: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """coders.normalised of many tables: entries (group, symbol) in order, counts above 0."""
    total = np.bincount(group, counts, groups).astype(np.int64)
    out = np.maximum(counts * SIZE // total[group], 1)
    left = np.bincount(group, -out, groups).astype(np.int64) + SIZE * (total > 0)
    order = np.lexsort((-counts, group))
    begin = np.cumsum(np.bincount(group, minlength=groups)) - np.bincount(group, minlength=groups)
    while left.any():
        o, g = out[order], group[order]
        may = (left[g] > 0) | (o > 1)
        before = np.cumsum(may) - may
        before -= np.concatenate([before, [0]])[begin[g]]
        now = may & (before < np.abs(left)[g])
        change = np.where(now, np.sign(left)[g], 0)
        out[order] = o + change
        left -= np.bincount(g, change, groups).astype(np.int64)
    return out


def packed_counts(group: np.ndarray, symbol: np.ndarray, norm: np.ndarray, groups: int) -> list[bytes]:
    """coders.pack_counts of many tables (entries as in normalised; every group has one)."""
    last = np.append(group[1:] != group[:-1], True)
    before = np.where(np.append(True, last[:-1]), -1, np.append(-1, symbol[:-1]))
    # for each entry a run of zeros before it, its count, and after the last a run of zeros
    value = np.stack([symbol - before - 1, norm + 1, np.where(last, 255 - symbol, 0)], 1).ravel()
    run = np.tile([True, False, True], len(group))
    n = 2 * bit_length(value) - 1
    v = np.where(run, 1 << np.maximum(n, 0), 0) | value
    some = value > 0
    return packed(np.repeat(group, 3)[some], (n + run)[some], v[some], groups)


def unpacked_counts(window: Window, at: np.ndarray, tables: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of all rows (tables x 256), the byte before each (0 where tables is None: one table a row and no such byte), each row's
    first table, and the byte after its last."""
    rows = len(at)
    many = np.ones(rows, np.int64) if tables is None else tables
    first = np.cumsum(many) - many
    norm, context = np.zeros((int(many.sum()), 256), np.int16), np.zeros(int(many.sum()), np.int64)
    lane, table, end = np.arange(rows), first.copy(), first + many
    at, symbol = at * 8, np.zeros(rows, np.int64)

    def named(lane, table, at):
        if tables is not None and len(lane):
            context[table] = window.get(lane, at, np.full(len(lane), 8))
        return at + 8 * (tables is not None)

    def gamma(lane, at):
        zeros = 32 - bit_length(window.get(lane, at, np.full(len(lane), 32)))
        return window.get(lane, at + zeros, zeros + 1), at + 2 * zeros + 1

    at = named(lane, table, at)
    after = np.zeros(rows, np.int64)
    while len(lane):
        v, at = gamma(lane, at)
        zero = v == 1
        norm[table[~zero], symbol[~zero]] = v[~zero] - 1
        step = np.ones(len(lane), np.int64)
        if zero.any():
            step[zero], at[zero] = gamma(lane[zero], at[zero])
        symbol = symbol + step
        full = symbol >= 256
        if full.any():
            symbol[full] = 0
            at[full] = -(-at[full] // 8) * 8
            table = table + full
            done = table >= end[lane]
            more = full & ~done
            after[lane[done]] = at[done] // 8
            at[more] = named(lane[more], table[more], at[more])
            lane, table, at, symbol = lane[~done], table[~done], at[~done], symbol[~done]
    return norm, context, first, after


def heads(lengths: np.ndarray) -> list[bytes]:
    return pieces(lengths.astype("<u4").tobytes(), np.full(len(lengths), 4))


def counted(x: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    """Entries of the tables of all rows: table, symbol, norm, and each byte's entry (rows x steps); each table's row and context."""
    rows, steps = x.shape
    here = np.arange(steps) < lengths[:, None]
    key = np.arange(rows)[:, None] << 16 | x
    if order:
        key[:, 1:] |= x[:, :-1].astype(np.int64) << 8
    entry, inverse, counts = np.unique(key[here], return_inverse=True, return_counts=True)
    table, index = np.unique(entry >> 8, return_inverse=True)
    norm = normalised(index, counts, len(table))
    at = np.zeros(x.shape, np.int64)
    at[here] = inverse.ravel()
    return index, entry & 255, norm, at, table >> 8, table & 255


# -- coders; each takes rows that are not empty, longest first --


def spread_states(norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """coders.states of many tables: the symbol of each state, and which of the symbol's states it is."""
    tables = len(norm)
    flat = norm.ravel().astype(np.int64)
    owner = np.repeat(np.tile(np.arange(256), tables), flat)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(flat) - flat, flat)
    key = ((2 * j + 1) * (1 << 40) // (2 * np.repeat(flat, flat))) << 19 | owner << 11 | j
    key = np.sort(key.reshape(tables, SIZE), axis=1)
    return key >> 11 & 255, key & (SIZE - 1)


def fse(data: list[bytes], lanes: Lanes) -> list[bytes]:
    x = lanes.matrix(data)
    rows = len(data)
    table, symbol, norm, entry, _, _ = counted(x, lanes.lengths, 0)
    dense = np.zeros((rows, 256), np.int64)
    dense[table, symbol] = norm
    owner, j = spread_states(dense)
    begin = np.cumsum(dense, axis=1) - dense
    place = np.zeros((rows, SIZE), np.int64)
    lane = np.arange(rows)[:, None]
    place[lane, begin[lane, owner] + j] = np.arange(SIZE)
    place, start = place.ravel(), (begin + SIZE * lane)[table, symbol] - norm
    usual = LOG + 1 - bit_length(2 * norm - 1)
    # from the last byte to the first: rows are aligned at their ends
    back = np.maximum(lanes.lengths[:, None] - 1 - np.arange(lanes.steps), 0)
    entry = np.take_along_axis(entry, back, 1).T.copy()
    state, v, n = np.full(rows, SIZE), np.zeros((lanes.steps, rows), np.int64), np.zeros((lanes.steps, rows), np.int64)
    for t, live in enumerate(lanes.live):
        e, s = entry[t, :live], state[:live]
        k = np.maximum(usual[e], 0)
        k += (s >> k) >= 2 * norm[e]
        v[t, :live], n[t, :live] = s & ((1 << k) - 1), k
        state[:live] = SIZE + place[start[e] + (s >> k)]
    v = np.concatenate([(state - SIZE)[:, None], np.take_along_axis(v.T, back, 1)], 1)
    n = np.concatenate([np.full((rows, 1), LOG), np.take_along_axis(n.T, back, 1)], 1)
    here = np.arange(lanes.steps + 1) <= lanes.lengths[:, None]
    bits = packed(np.nonzero(here)[0], n[here], v[here], rows)
    return [b"".join(p) for p in zip(heads(lanes.lengths), packed_counts(table, symbol, norm, rows), bits)]


def undo_fse(stored: list[bytes], lanes: Lanes) -> list[bytes]:
    rows = len(stored)
    window = Window(lanes.matrix(stored, 16))
    norm, _, _, at = unpacked_counts(window, np.full(rows, 4), None)
    symbol, nth = spread_states(norm)
    nth += norm[np.arange(rows)[:, None], symbol]
    bits = LOG + 1 - bit_length(nth)
    base, bits, symbol = ((nth << bits) - SIZE).ravel(), bits.ravel(), symbol.astype(np.uint8).ravel()
    lane = np.arange(rows)
    at = at * 8 + LOG
    state = window.get(lane, at - LOG, np.full(rows, LOG)) + lane * SIZE
    out = np.zeros((lanes.steps, rows), np.uint8)
    for t, live in enumerate(lanes.live):
        s, a, own = state[:live], at[:live], lane[:live]
        out[t, :live] = symbol[s]
        k = bits[s]
        state[:live] = base[s] + window.get(own, a, k) + own * SIZE
        at[:live] = a + k
    return rows_of(out, lanes)


def rows_of(out: np.ndarray, lanes: Lanes) -> list[bytes]:
    return pieces(out.T[np.arange(lanes.steps) < lanes.lengths[:, None]].tobytes(), lanes.lengths)


def ans(data: list[bytes], lanes: Lanes, order: int = 0) -> list[bytes]:
    x = lanes.matrix(data)
    rows = len(data)
    table, symbol, norm, entry, owner, context = counted(x, lanes.lengths, order)
    sums = np.cumsum(norm) - norm
    begin = sums % SIZE  # tables sum to SIZE
    back = np.maximum(lanes.lengths[:, None] - 1 - np.arange(lanes.steps), 0)
    entry = np.take_along_axis(entry, back, 1).T.copy()
    state = np.full(rows, LOW)
    put, used = np.zeros((lanes.steps, 2, rows), np.uint8), np.zeros((lanes.steps, 2, rows), bool)
    for t, live in enumerate(lanes.live):
        e, s = entry[t, :live], state[:live]
        f = norm[e]
        top = f * (LOW >> LOG << 8)
        for i in range(2):  # states have 31 bits
            over = s >= top
            put[t, i, :live], used[t, i, :live] = s & 255, over
            s = np.where(over, s >> 8, s)
        high, low = np.divmod(s, f)
        state[:live] = (high << LOG) + low + begin[e]
    put, used = put.reshape(-1, rows)[::-1].T, used.reshape(-1, rows)[::-1].T
    bodies = pieces(put[used].tobytes(), used.sum(axis=1))
    tables: list[bytearray] = [bytearray([n - 1]) for n in np.bincount(owner, minlength=rows).tolist()]
    for row, c, p in zip(owner.tolist(), context.tolist(), packed_counts(table, symbol, norm, len(owner))):
        tables[row].append(c)
        tables[row] += p
    return [b"".join(p) for p in zip(heads(lanes.lengths), tables, heads(state), bodies)]


def undo_ans(stored: list[bytes], lanes: Lanes, order: int = 0) -> list[bytes]:
    rows = len(stored)
    data = lanes.matrix(stored, 16)
    window = Window(data)
    norm, context, first, at = unpacked_counts(window, np.full(rows, 5), data[:, 4].astype(np.int64) + 1)
    many = np.diff(np.append(first, len(norm)))
    table = np.zeros((rows, 256), np.int64)
    table[np.repeat(np.arange(rows), many), context] = np.arange(len(norm))
    table = table.ravel()
    owner = np.repeat(np.tile(np.arange(256, dtype=np.uint8), len(norm)), norm.ravel())
    begin = (np.cumsum(norm, axis=1, dtype=np.int16) - norm).ravel()
    norm, flat, width = norm.ravel(), data.ravel(), data.shape[1]
    lane = np.arange(rows)
    state = np.zeros(rows, np.int64)
    for i in range(4):
        state |= flat[lane * width + at + i].astype(np.int64) << 8 * i
    at = lane * width + at + 4
    out = np.zeros((lanes.steps, rows), np.uint8)
    now = table[lane * 256]
    for t, live in enumerate(lanes.live):
        s, c = state[:live], now[:live]
        low = s & (SIZE - 1)
        symbol = owner[c * SIZE + low]
        out[t, :live] = symbol
        e = c * 256 + symbol
        s = norm[e].astype(np.int64) * (s >> LOG) + low - begin[e]
        a = at[:live]
        for _ in range(2):
            under = s < LOW
            s = np.where(under, s << 8 | flat[a], s)
            a = a + under
        state[:live], at[:live] = s, a
        if order:
            now[:live] = table[lane[:live] * 256 + symbol]
    return rows_of(out, lanes)


class Arithmetic:
    """coders.Arithmetic for many rows: the bits that both ends share leave at once, then those that straddle the middle."""

    def __init__(self, rows: int, window: Window | None = None, at: np.ndarray | None = None):
        self.low, self.high, self.later = np.zeros(rows, np.int64), np.full(rows, 2 * HALF - 1), np.zeros(rows, np.int64)
        self.lane, self.window, self.records = np.arange(rows), window, []
        if window:
            self.at = at * 8 + 32
            self.code = window.get(self.lane, at * 8, np.full(rows, 32))

    def narrow(self, live: int, low: np.ndarray, high: np.ndarray, log: int) -> None:
        a, width = self.low[:live], self.high[:live] - self.low[:live] + 1
        a, b = a + (width * low >> log), a + (width * high >> log) - 1
        k = 32 - bit_length(a ^ b)
        if not self.window:
            some = np.flatnonzero(k)
            if len(some):
                self.records.append((some, k[some], a[some] >> (32 - k[some]), self.later[some]))
                self.later[some] = 0
        full = 2 * HALF - 1
        a, b = a << k & full, (b << k | ((1 << k) - 1)) & full
        j = 31 - bit_length((~a | b) & (HALF - 1))
        self.low[:live] = a << j & (HALF - 1)
        self.high[:live] = HALF | (b << j | ((1 << j) - 1)) & (HALF - 1)
        if self.window:
            at = self.at[:live]
            bits = self.window.get(self.lane[:live], at, k + j)
            code = self.code[:live] << k & full
            self.code[:live] = ((code | bits >> j) - HALF << j) + HALF + (bits & ((1 << j) - 1))
            self.at[:live] = at + k + j
        else:
            self.later[:live] += j

    def target(self, live: int, log: int) -> np.ndarray:
        low = self.low[:live]
        return (((self.code[:live] - low + 1) << log) - 1) // (self.high[:live] - low + 1)

    def done(self) -> list[bytes]:
        rows = len(self.low)
        self.records.append((self.lane, np.ones(rows, np.int64), (self.low >= HALF >> 1).astype(np.int64), self.later + 1))
        row, k, v, later = (np.concatenate(c) for c in zip(*self.records))
        order = np.argsort(row, kind="stable")
        row, k, v, later = row[order], k[order], v[order], later[order]
        # the first bit, its opposites, the rest; long runs of opposites in several records
        first, rest = v >> (k - 1), v & ((1 << (k - 1)) - 1)
        parts = -(-later // 16)
        reps = parts + 2
        begin = np.cumsum(reps) - reps
        which = np.repeat(np.arange(len(row)), reps)
        nth = np.arange(len(which)) - begin[which]
        last = nth == reps[which] - 1
        n = np.where(nth == 0, 1, np.where(last, (k - 1)[which], np.minimum(16, later[which] - 16 * (nth - 1))))
        value = np.where(nth == 0, first[which], np.where(last, rest[which], np.where(first[which] == 1, 0, (1 << np.maximum(n, 0)) - 1)))
        return packed(row[which], n, value, rows)


def ranged(data: list[bytes], lanes: Lanes) -> list[bytes]:
    x = lanes.matrix(data)
    table, symbol, norm, entry, _, _ = counted(x, lanes.lengths, 0)
    begin = (np.cumsum(norm) - norm) % SIZE
    end, coder, entry = begin + norm, Arithmetic(len(data)), entry.T.copy()
    for t, live in enumerate(lanes.live):
        e = entry[t, :live]
        coder.narrow(live, begin[e], end[e], LOG)
    return [b"".join(p) for p in zip(heads(lanes.lengths), packed_counts(table, symbol, norm, len(data)), coder.done())]


def undo_ranged(stored: list[bytes], lanes: Lanes) -> list[bytes]:
    rows = len(stored)
    window = Window(lanes.matrix(stored, 16))
    norm, _, _, at = unpacked_counts(window, np.full(rows, 4), None)
    owner = np.repeat(np.tile(np.arange(256, dtype=np.uint8), rows), norm.ravel())
    end = np.cumsum(norm, axis=1, dtype=np.int64).ravel()
    begin = end - norm.ravel()
    coder, out, lane = Arithmetic(rows, window, at), np.zeros((lanes.steps, rows), np.uint8), np.arange(rows)
    for t, live in enumerate(lanes.live):
        symbol = owner[lane[:live] * SIZE + coder.target(live, LOG)]
        out[t, :live] = symbol
        e = lane[:live] * 256 + symbol
        coder.narrow(live, begin[e], end[e], LOG)
    return rows_of(out, lanes)


def model_states() -> tuple[np.ndarray, np.ndarray]:
    """The states of a model (probability, times seen) that can be, the first one first: their probabilities, and their successors
    after a 0 and after a 1."""
    number, todo, after = {(ONE // 2, 0): 0}, [(ONE // 2, 0)], []
    for p, n in todo:
        for bit in (0, 1):
            to = p + ((bit << 12) - p) // (n + 2), min(n + 1, 30)
            if to not in number:
                number[to] = len(todo)
                todo.append(to)
            after.append(number[to])
    return np.array([p for p, _ in todo]), np.array(after, np.uint16)


TABLES: list[np.ndarray] = []


def model_tables() -> list[np.ndarray]:
    if not TABLES:
        p, after = model_states()
        TABLES.extend([p, np.array(STRETCH)[p], after, np.array([max(min(squash(x), ONE - 1), 1) for x in range(-2047, 2048)])])
    return TABLES


def mixed(given: list[bytes], lanes: Lanes, orders: tuple[int, ...], coding: bool) -> list[bytes]:
    rows, deep = len(given), max(orders)
    lane = np.arange(rows)
    chance, stretch, after, squashed = model_tables()
    data = lanes.matrix(given).astype(np.int64) if coding else np.zeros((rows, lanes.steps), np.int64)
    coder = Arithmetic(rows) if coding else Arithmetic(rows, Window(lanes.matrix(given, 16)), np.full(rows, 4))
    # contexts are numbered by where they first occur; a model is a table of 256 nodes
    keys = np.zeros((len(orders), rows, lanes.steps), np.int64)
    models = np.zeros(len(orders) * rows * lanes.steps * 256, np.uint16)
    weights = np.full((len(orders), rows), (1 << 16) // len(orders))
    which = np.arange(len(orders))[:, None]
    for t, live in enumerate(lanes.live):
        for i, o in enumerate(orders):
            had = min(t, deep)
            length = o if had >= o else min(had, o - had)  # as coders.Mixture cuts the past
            key = np.full(live, length << 56)
            for back in range(length):
                key |= data[:live, t - 1 - back] << 8 * back
            keys[i, :live, t] = key
        first = (keys[:, :live, : t + 1] == keys[:, :live, t : t + 1]).argmax(axis=2)
        base = ((which * rows + lane[:live]) * lanes.steps + first) << 8
        node = np.ones(live, np.int64)
        own = weights[:, :live]
        for shift in range(7, -1, -1):
            at = base + node
            state = models[at]
            if len(orders) == 1:
                p = np.clip(chance[state[0]], 1, ONE - 1)
            else:
                s = stretch[state]
                p = squashed[np.clip((own * s).sum(axis=0) >> 16, -2047, 2047) + 2047]
            bit = data[:live, t] >> shift & 1 if coding else (coder.target(live, 12) < p).astype(np.int64)
            coder.narrow(live, np.where(bit, 0, p), np.where(bit, p, ONE), 12)
            if len(orders) > 1:
                own += s * ((bit << 12) - p) >> 10
            models[at] = after[2 * state.astype(np.int64) + bit]
            node = node << 1 | bit
        if not coding:
            data[:live, t] = node & 255
    if coding:
        return [b"".join(p) for p in zip(heads(lanes.lengths), coder.done())]
    return rows_of(data.T.astype(np.uint8), lanes)


def many(run: Callable[[list[bytes], Lanes], list[bytes]], alone: Callable[[bytes], bytes], cost: Callable[[int], int], limit: int, undo: bool) -> Callable[[list[bytes]], list[bytes]]:
    """run over any blocks, by falling length, as many at a time as cost (bytes for a block) allows. Empty blocks, those longer than
    limit and those without 15 others at least half as long are coded alone."""

    def all_of(data: list[bytes]) -> list[bytes]:
        lengths = np.array([int.from_bytes(x[:4], "little") if undo else len(x) for x in data], np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order].tolist()
        out, at = [b""] * len(data), 0
        while at < len(order):
            n = sizes[at]
            if not 0 < n <= limit or at + 15 >= len(order) or 2 * sizes[at + 15] < n:
                out[order[at]] = alone(data[order[at]])
                at += 1
                continue
            some = order[at : at + max(16, min(LANES, ROOM // cost(n)))]
            some = some[lengths[some] > 0]
            for i, x in zip(some.tolist(), run([data[i] for i in some.tolist()], Lanes(lengths[some]))):
                out[i] = x
            at += len(some)
        return out

    return all_of


def both(name: str, code: Callable, undo: Callable, cost: Callable[[int], int], limit: int) -> tuple[Callable, Callable]:
    return many(code, CODERS[name][0], cost, limit, False), many(undo, CODERS[name][1], cost, limit, True)


#: by the names in coders.CODERS: all blocks of a list, and back
MANY = {
    "fse": both("fse", fse, undo_fse, lambda n: 40 * n + 16 * SIZE, 1 << 16), "range": both("range", ranged, undo_ranged, lambda n: 40 * n + 4 * SIZE, 1 << 16),
    "ans0": both("ans0", ans, undo_ans, lambda n: 40 * n + 4 * SIZE, 1 << 16), "ans1": both("ans1", lambda d, at: ans(d, at, 1), lambda d, at: undo_ans(d, at, 1), lambda n: 40 * n + min(n, 256) * SIZE // 4, 1 << 16),
    **{name: both(name, lambda d, at, o=o: mixed(d, at, o, True), lambda d, at, o=o: mixed(d, at, o, False), lambda n, o=o: 600 * n * len(o), 1 << 11) for name, o in MIXTURES.items()},
}
