"""Windows of W tokens that also start earlier: the engine of substring dedup (words) and suffix-array dedup (bytes).

Sampling. Of every W tokens in a row, one k-gram is the anchor: the least by hash among the W - k + 1 (the rightmost of
equal ones). The choice depends on the window's content alone, so equal windows have equal anchors at equal distances
(a synchronising set). Neighbouring windows share anchors: an anchor stands for a run of windows, and about one anchor is
kept for W / 2 tokens.

Extension. Rows meet where they share a core: strings of tokens that all windows of the row hold at the same place. The first
core is the anchor. Rows of a core that nobody else has are done. Rows with equal content (all tokens of their
windows) repeat as a whole: all but the first are covered. What else shares a core is extended: the windows of a row are dealt
into three parts by the anchor's place in them, and the windows of a part share a core that is longer on both
sides. For W - k + 1 = 81 places the parts hold 27, 9, 3 and 1 windows, so after four steps the core is the window itself.
A step makes at most three rows of one, and only of rows that share a core with other contents.

Equality is that of 64-bit hashes of contents among rows with equal 64-bit hashes of cores. Tokens are bytes, or
words by a 64-bit hash.

Skew. Cores and contents are counted with partial aggregates that are joined back by sort-merge joins, whose skewed
partitions Spark splits; no group is gathered in a task, however many rows share a core.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import Staged, id_order, slices, text_or_empty

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PLACE_BITS = 24
PLACE_MASK = (1 << PLACE_BITS) - 1
CHUNK_TOKENS = 1 << 19


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, kept up to the usual chunk's size."""
    size = max(n, CHUNK_TOKENS + (1 << 16))
    if size not in _POWERS:
        up, down = (np.full(size, x, np.uint64) for x in (BASE, BASE_INVERSE))
        up[0] = down[0] = 1
        made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > CHUNK_TOKENS + (1 << 16):
            return made
        _POWERS[size] = made
    return _POWERS[size]


class Hashes:
    """Polynomial hashes of any substring of a token array."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = powers(len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def text_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def byte_tokens(data: np.ndarray) -> np.ndarray:
    return BYTE_VALUES[data]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: longest runs of bytes other than white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_tokens(data: np.ndarray) -> np.ndarray:
    start, end = word_spans(data)
    return Hashes(BYTE_VALUES[data]).of(start, end) + (end - start).astype(np.uint64)


class Kind:
    """What a token is. keep: how contexts travel (bytes as they are, words as hashes)."""

    def __init__(self, name: str, window: int, gram: int):
        self.name, self.window, self.gram = name, window, gram
        self.unit = np.uint8 if name == "bytes" else np.uint64

    def raw(self, text: str) -> np.ndarray:
        data = text_bytes(text)
        return data if self.name == "bytes" else word_tokens(data)

    def values(self, raw: np.ndarray) -> np.ndarray:
        return BYTE_VALUES[raw] if self.name == "bytes" else raw


def content(hashes: Hashes, at: np.ndarray, n: np.ndarray, o: np.ndarray, window: int) -> np.ndarray:
    """Hash of all tokens of the n windows from `at` on, whose first one has its anchor at place o."""
    return hashes.of(at, at + n - 1 + window) + mixed((o * 4096 + n).astype(np.uint64))


def anchors(tokens: np.ndarray, ends: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Anchor runs of the documents that end at ends in tokens: document number, first window (in its document), number of
    windows, place of the anchor in the first window, hash of the anchor, hash of the run's tokens."""
    n_windows = len(tokens) - window + 1
    start = np.concatenate([[0], ends[:-1]])
    per = np.maximum(np.diff(np.concatenate([[0], ends])) - window + 1, 0)
    empty = np.zeros(0, np.int64)
    if n_windows < 1 or not per.sum():
        return {"doc": empty, "lo": empty, "n": empty, "o": empty, "ah": empty.astype(np.uint64), "ch": empty.astype(np.uint64)}
    hashes = Hashes(tokens)
    grams = hashes.grams(gram)
    place = np.uint64(PLACE_MASK) - np.arange(len(grams), dtype=np.uint64)
    at = PLACE_MASK - (sliding_min((grams & ~np.uint64(PLACE_MASK)) | place, window - gram + 1) & np.uint64(PLACE_MASK)).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), per)
    p = np.arange(len(doc)) + np.repeat(start - np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    a = at[p]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(first, len(a)))
    lo, a, doc = p[first], a[first], doc[first]
    return {"doc": doc, "lo": lo - start[doc], "n": n, "o": a - lo, "ah": grams[a], "ch": content(hashes, lo, n, a - lo, window)}


def chunks(raws: list[np.ndarray]):
    """Consecutive documents in chunks of about CHUNK_TOKENS tokens: (first, last + 1)."""
    i = 0
    while i < len(raws):
        j, size = i, 0
        while j < len(raws) and (j == i or size + len(raws[j]) <= CHUNK_TOKENS):
            size += len(raws[j])
            j += 1
        yield i, j
        i = j


def long_parts(raw: np.ndarray, window: int):
    """A document in parts that chunks can hold; neighbours share window - 1 tokens, so each window lies in one part."""
    step = CHUNK_TOKENS - window + 1
    for s in range(0, max(len(raw) - window + 1, 1), step):
        yield s, raw[s : s + CHUNK_TOKENS]


def anchor_rows(docs: DataFrame, kind: Kind) -> DataFrame:
    """core, content, id, lo, n, o for every anchor run of every document."""

    def run(batches):
        for b in slices(batches):
            ids, raws, shift = [], [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                raw = kind.raw(text)
                if len(raw) < kind.window:
                    continue
                for s, part in long_parts(raw, kind.window) if len(raw) > CHUNK_TOKENS else ((0, raw),):
                    ids.append(i)
                    raws.append(part)
                    shift.append(s)
            for i, j in chunks(raws):
                x = anchors(kind.values(np.concatenate(raws[i:j])), np.cumsum([len(r) for r in raws[i:j]]), kind.window, kind.gram)
                own_ids, own_shift = np.array(ids[i:j], np.int64), np.array(shift[i:j], np.int64)
                yield batch(ROW, x["ah"], x["ch"], own_ids[x["doc"]], x["lo"] + own_shift[x["doc"]], x["n"], x["o"])

    return docs.mapInArrow(run, ROW)


ROW = "core long, content long, id long, lo long, n int, o int"


def batch(schema: str, *columns) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    kinds = [{"long": np.int64, "int": np.int32}[k] for k in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(columns, kinds)], names=list(names))


def judged(rows: DataFrame, within: bool, staged: Staged, tag: str, part: bool = False) -> DataFrame:
    """Of rows (core, content, id, lo, ...) those that are covered, and those that share a core with other contents (not covered).
    part: see Staged.write_part."""
    write = staged.write_part if part else staged.write
    cores = rows.groupBy(F.col("core").alias("c_core")).agg(F.count("*").alias("times"), (F.min("content") < F.max("content")).alias("mixed")).where("times > 1").drop("times")
    cores = write(cores, f"cores-{tag}")
    shared = write(rows.join(cores.hint("merge"), F.col("core") == F.col("c_core")).drop("c_core"), f"shared-{tag}")
    staged.drop(f"cores-{tag}")
    # contents of several rows, and the first of them; all others are alone
    classes = shared.groupBy(F.col("core").alias("c_core"), F.col("content").alias("c_content")).agg(F.min(F.struct("id", "lo")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    classes = write(classes, f"classes-{tag}")
    covered = F.struct("id", "lo") > F.col("first") if within else F.col("id") > F.col("first.id")
    out = shared.join(classes.hint("merge"), (F.col("core") == F.col("c_core")) & (F.col("content") == F.col("c_content")), "left")
    out = out.withColumn("covered", F.coalesce(covered, F.lit(False))).where("covered OR mixed").drop("c_core", "c_content", "core", "content", "first", "mixed")
    out = write(out, f"judged-{tag}")
    staged.drop(f"classes-{tag}")
    staged.drop(f"shared-{tag}")
    return out


def cut_contexts(wanted: DataFrame, docs: DataFrame, kind: Kind) -> DataFrame:
    """The rows of wanted (id, lo, n, o) with the tokens of their windows, and the places that their anchors may have."""
    per_doc = wanted.groupBy("id").agg(F.collect_list(F.struct("lo", "n", "o")).alias("rows"))
    joined = docs.join(per_doc.hint("merge"), "id")

    def run(batches):
        for b in slices(batches):
            out = []
            for i, text, rows in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("rows").to_pylist()):
                raw = kind.raw(text)
                for r in rows:
                    if r["lo"] + r["n"] + kind.window - 1 > len(raw):
                        continue  # of another text under the same id
                    out.append((i, r["lo"], r["o"], raw[r["lo"] : r["lo"] + r["n"] + kind.window - 1].tobytes(), [{"f": r["o"] - r["n"] + 1, "l": r["o"]}]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), RANGES))], names=["id", "lo", "o", "tokens", "ranges"])

    cut = joined.select("id", "text", "rows").mapInArrow(run, "id long, lo long, o int, tokens binary, ranges array<struct<f:int,l:int>>")
    return cut.withColumn("context", F.monotonically_increasing_id())


RANGES = pa.list_(pa.struct([("f", pa.int32()), ("l", pa.int32())]))
PART = ROW + ", context long"


def parts(contexts: DataFrame, kind: Kind, size: int) -> DataFrame:
    """The windows of contexts in parts: those of a part have their anchors at `size` neighbouring places at most, and so share a
    core. ranges: of each context the first and last places of anchors that are wanted."""
    last = kind.window - kind.gram

    def run(batches):
        for whole in slices(batches):
            tokens = [np.frombuffer(c, kind.unit) for c in whole.column("tokens").to_pylist()]
            for i, j in chunks(tokens):
                b = whole.slice(i, j - i)
                hashes = Hashes(kind.values(np.concatenate(tokens[i:j])))
                lengths = np.array([len(t) for t in tokens[i:j]])
                base = np.cumsum(lengths) - lengths
                ranges = b.column("ranges")
                row = np.repeat(np.arange(j - i), ranges.value_lengths().to_numpy(zero_copy_only=False))
                f, l = (ranges.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "fl")
                first, many = f // size, l // size - f // size + 1
                take = np.repeat(np.arange(len(row)), many)
                block = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(take))
                row, f, l = row[take], np.maximum(f[take], block * size), np.minimum(l[take], block * size + size - 1)
                o = b.column("o").to_numpy().astype(np.int64)[row]
                anchor, n = base[row] + o, l - f + 1
                core = hashes.of(anchor - block * size, anchor - np.minimum(block * size + size - 1, last) + kind.window)
                core = mixed(core + (block + 1).astype(np.uint64) * np.uint64(BASE))
                ids, lo, context = (b.column(c).to_numpy()[row] for c in ("id", "lo", "context"))
                yield batch(PART, core, content(hashes, anchor - l, n, l, kind.window), ids, lo + o - l, n, l, context)

    return contexts.mapInArrow(run, PART)


def repeated_windows(docs: DataFrame, kind: Kind, within: bool, staged: Staged) -> DataFrame:
    """id, lo, n: runs of windows that also start earlier. docs: id (long, not null), text (not null)."""
    rows = staged.write(anchor_rows(docs, kind), "rows")
    now = judged(rows, within, staged, "anchors")
    staged.drop("rows")
    found = now.where("covered").select("id", "lo", "n")
    contexts = staged.write(cut_contexts(now.where("NOT covered").select("id", "lo", "n", "o"), docs, kind), "contexts-0")
    size = kind.window - kind.gram + 1
    while size > 1:
        before, size = size, -(-size // 3)
        rows = staged.write_part(parts(contexts, kind, size), f"parts-{size}")
        now = judged(rows, within, staged, f"step-{size}", part=True)
        staged.drop(f"parts-{size}")
        found = found.unionByName(now.where("covered").select("id", "lo", "n"))
        if size == 1 or now.where("NOT covered").isEmpty():
            break
        left = now.where("NOT covered").groupBy(F.col("context").alias("l_context")).agg(F.collect_list(F.struct((F.col("o") - F.col("n") + 1).alias("f"), F.col("o").alias("l"))).alias("ranges"))
        kept = contexts.drop("ranges").join(left.hint("merge"), F.col("context") == F.col("l_context")).drop("l_context")
        contexts = staged.write_part(kept, f"contexts-{size}")
        staged.drop("contexts-0" if before == kind.window - kind.gram + 1 else f"contexts-{before}")
    out = staged.write_part(found, "repeats")
    return out


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """id (null sorts first), text (null is empty), and the columns of keep under other names."""
    return docs.select(*[F.col(c).alias(f"__keep_{c}") for c in keep], id_order().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def with_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """Each document with the list of its runs (null: none)."""
    per_doc = repeats.groupBy(F.col("id").alias("r_id")).agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    return docs.join(per_doc, F.col("id") == F.col("r_id"), "left").drop("r_id")


def covered_tokens(size: int, runs, window: int) -> np.ndarray:
    """Which tokens lie in a window of the runs."""
    mark = np.zeros(size + 1, np.int32)
    if runs:
        lo = np.minimum(np.array([r["lo"] for r in runs]), size)
        n = np.array([r["n"] for r in runs])
        np.add.at(mark, lo, 1)
        np.add.at(mark, np.minimum(lo + n - 1 + window, size), -1)
    return np.cumsum(mark[:-1]) > 0
