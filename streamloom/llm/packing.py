"""Packing by cutting-stock column generation.

Documents become token ids (an end id is added) and are cut into pieces of `capacity` and a rest. Pieces of at most `short`
tokens are first joined into bundles of about `bundle` tokens, which then are packed like pieces. Lengths are counted
in units of `unit` tokens, so the histogram has capacity / unit classes whatever the input's size. A linear program
covers the histogram with patterns (how many pieces of each class share a sequence): the simplex method keeps a basis
of patterns, and a knapsack dynamic program over the dual prices finds the column to enter. Multiplicities are rounded
down; what is left (less than a few pieces a pattern) is packed first-fit decreasing. Pieces and bundles are ranked within their
class, and a rank finds its pattern, copy and sequence in the table of rank intervals, which is as small as the basis.

Sequences shorter than capacity are padded to it, but not where their length is a power of two: a sequence of the
remainder that would be filled badly is cut into power-of-two sequences instead.

Ranks are running counts in buckets of a hash plus the totals of the buckets before, so one class may hold any share
of the pieces.

Defined cases: null text is empty and becomes the end id alone; null doc_id is an id like others; equal rows are packed
each for itself; a text of any length is cut; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from array import array
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.common import KEPT, Staged, slices, table, text_or_empty

# fixed value: how the tokenizer cuts text that holds only the characters "!" to "~" and the letters of Latin-1
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-ÿ]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: what a whole text of these characters and blanks is cut into in lower case, and what such a text does not hold
PARTS = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+")
STRANGE = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]|<\|")
BLANK = re.compile(r"[ \n\t\r]+")
#: byte-level characters: bytes that print stand for themselves, others for the code points from 256 on
PRINTING = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in PRINTING)}
#: white space that str.split() cuts at and the tokenizer does not take for a blank
RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WORD_LIMIT, LONGEST = 200_000, 64


class Words(dict):
    """Ids (as bytes) of words between blanks, and of the parts that words are cut into before merging: both have the same ids
    alone as within their text. When WORD_LIMIT keys are new, those that were not used since the last time are
    forgotten; keys of more than LONGEST characters are not kept, which bounds the bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.unit = tokenizer, "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.merge, self.before = tokenizer.model.tokenize, {}

    def make(self, word: str) -> bytes:
        if "<|" in word or not PLAIN.fullmatch(word):
            return array(self.unit, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        if not (low.isascii() and low.isalpha()):
            parts = PRETOKEN.findall(low)
            if len(parts) > 1:
                return b"".join([self[p] for p in parts])
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        elif low != word:
            return self[low]
        return array(self.unit, [t.id for t in self.merge(low)]).tobytes()

    def part(self, low: str) -> bytes:
        """Ids of what PARTS found."""
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return array(self.unit, [t.id for t in self.merge(low)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        value = self.before.get(word)
        if value is None:
            value = self.part(word) if PARTS.fullmatch(word) else self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= WORD_LIMIT:
                self.before = dict(self)
                self.clear()
            self[word] = value
        return value


class Encoder:
    """Token ids of texts, word by word. Words that were seen keep their ids, up to a limit, then the memory starts anew."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One for each Python worker: it outlives the task."""
        kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT))
        if getattr(kept, "encoder_path", None) != path:
            kept.encoder, kept.encoder_path = cls(path), path
        return kept.encoder

    def encode(self, text: str) -> np.ndarray:
        words = self.words
        if STRANGE.search(text) is None:
            return np.frombuffer(b"".join(map(words.__getitem__, PARTS.findall(text.lower()))), words.unit).astype(np.uint32)
        cut = text.split() if RARE.search(text) is None else BLANK.split(text)
        return np.frombuffer(b"".join(map(words.__getitem__, cut)), words.unit).astype(np.uint32)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens."""
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))

    def run(batches):
        encoder = Encoder.of(tokenizer_path)
        for b in slices(batches, keep=True):
            ids_col, out = b.column("doc_id").to_pylist(), []
            for doc, text in zip(ids_col, b.column("text").to_pylist()):
                ids = np.append(encoder.encode(text), np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), capacity):
                    piece = ids[s : s + capacity]
                    out.append((doc, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(prices: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Best worth of classes 1..n (class k weighs k) in a sequence of size units, and how many of each."""
    best, pick = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    n = len(prices)
    for c in range(1, size + 1):
        k = min(c, n)
        worth = best[c - k : c][::-1] + prices[:k]  # class j = 1..k leaves c - j
        j = int(np.argmax(worth))
        if worth[j] > best[c - 1] + 1e-12:
            best[c], pick[c] = worth[j], j + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(n, np.int64), size
    while c > 0:
        if pick[c]:
            counts[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return float(best[size]), counts


def inverted(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots, in plain array operations: the driver's threads of a linear algebra library
    may not survive a fork."""
    n = len(basis)
    work = np.concatenate([basis, np.eye(n)], axis=1)
    for c in range(n):
        p = c + int(np.argmax(np.abs(work[c:, c])))
        work[[c, p]] = work[[p, c]]
        work[c] /= work[c, c]
        factor = work[:, c].copy()
        factor[c] = 0
        some = np.flatnonzero(factor)
        work[some] -= factor[some, None] * work[c]
    return work[:, n:]


def column_generation(demand: np.ndarray, tolerance: float = 5e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their real multiplicities that cover demand[k - 1] pieces of class k, by at most 1 + tolerance times
    the least number of sequences."""
    size = len(demand)
    used = np.flatnonzero(demand > 0)
    m = len(used)
    if not m:
        return np.zeros((0, size), np.int64), np.zeros(0)
    weights = used + 1
    basis = np.diag(size // weights).astype(float)  # columns are patterns over the used classes
    # demands are moved apart by less than matters, so that every step gains and the steps end
    inverse, x = np.diag(1.0 / (size // weights)), (demand[used] + 1e-6 * np.arange(1, m + 1) / m) / (size // weights)
    for i in count():
        duals = inverse.sum(axis=0)
        prices = np.zeros(size)
        prices[used] = np.maximum(duals, 0)
        worth, counts = knapsack(prices, size)
        if worth <= 1 + tolerance:
            break
        column = counts[used].astype(float)
        step = (inverse * column).sum(axis=1)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        r = int(np.argmin(ratio))
        x = np.maximum(x - ratio[r] * step, 0)
        x[r] = ratio[r]
        basis[:, r] = column
        row = inverse[r] / step[r]
        inverse -= step[:, None] * row
        inverse[r] = row
        if i % 100 == 99:
            inverse = inverted(basis)
    patterns = np.zeros((m, size), np.int64)
    patterns[:, used] = basis.T.round().astype(np.int64)
    return patterns, x


def first_fit(left: np.ndarray) -> list[np.ndarray]:
    """Sequences for the pieces that rounding leaves; they are few: less than the basis has entries."""
    size, bins, room = len(left), [], []
    for k in range(size, 0, -1):
        for _ in range(int(left[k - 1])):
            at = next((i for i, r in enumerate(room) if r >= k), None)
            if at is None:
                bins.append(np.zeros(size, np.int64))
                room.append(size)
                at = len(bins) - 1
            bins[at][k - 1] += 1
            room[at] -= k
    return bins


def plan(demand: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rank intervals (class, first rank, first sequence, pieces of the class in a sequence, sequences), and from which sequence
    on those of the remainder come."""
    patterns, x = column_generation(demand)
    times = np.floor(x + 1e-9).astype(np.int64)
    left = demand.astype(np.int64).copy()
    todo = []
    for p, t in zip(patterns, times):
        able = min((int(left[k] // p[k]) for k in np.flatnonzero(p)), default=0)
        t = min(int(t), able)
        if t > 0:
            todo.append((p, t))
            left -= p * t
    bins = first_fit(left)
    intervals, rank, sequence = [], np.zeros(len(demand), np.int64), 0
    rest_from = sum(t for _, t in todo)
    for p, t in [*todo, *((b, 1) for b in bins)]:
        for k in np.flatnonzero(p):
            intervals.append((int(k) + 1, int(rank[k]), sequence, int(p[k]), t))
            rank[k] += p[k] * t
        sequence += t
    return intervals, rest_from


def split_powers(rows: list[tuple], capacity: int, first_sequence: int, fill: float = 0.97) -> list[tuple]:
    """Pieces (doc, start, length, key...) of badly filled sequences, cut again so that each sequence is a power of two long.

    rows: of each sequence its pieces in order, as (sequence, piece index, length). Returns (piece index, from, length, sequence, offset).
    """
    out, new = [], first_sequence
    for pieces in rows:
        used = sum(n for _, n in pieces)
        if used >= fill * capacity or used & (used - 1) == 0:
            at = 0
            for i, n in pieces:
                out.append((i, 0, n, new, at))
                at += n
            new += 1
            continue
        room, at = 1 << (used.bit_length() - 1), 0
        for i, n in pieces:
            s = 0
            while s < n:
                take = min(n - s, room - at)
                out.append((i, s, take, new, at))
                s, at, used = s + take, at + take, used - take
                if at == room:
                    new, at, room = new + 1, 0, 1 << max(used.bit_length() - 1, 0)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, unit: int = 16, bucket_rows: int = 4096, short: int = 128, bundle: int = 512) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    staged = Staged(spark, "pack")
    pieces = tokenize(docs, tokenizer_path, end_id, capacity).withColumn("piece", F.monotonically_increasing_id())
    pieces = staged.write(pieces, "pieces")
    size = capacity // unit
    # short pieces in bundles: consecutive ones of a bucket until `bundle` tokens are full; a bundle is named by its first piece
    little = pieces.where(F.col("length") <= short).select("piece", "length")
    n_buckets = little.count() // bucket_rows + 1
    little = little.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(n_buckets)))
    little = little.withColumn("before", F.sum("length").over(Window.partitionBy("bucket").orderBy("piece")) - F.col("length"))
    little = little.withColumn("at", F.floor(F.col("before") / bundle)).withColumn("item", F.min("piece").over(Window.partitionBy("bucket", "at")))
    bundled = pieces.join(little.select(F.col("piece").alias("l_piece"), "item"), F.col("piece") == F.col("l_piece"), "left").drop("l_piece").withColumn("item", F.coalesce("item", "piece"))
    bundled = staged.write(bundled, "bundled")
    staged.drop("pieces")
    items = staged.write(bundled.groupBy("item").agg(F.sum("length").alias("item_length")).select("item", F.ceil(F.col("item_length") / unit).cast("int").alias("k")), "items")
    histogram = np.zeros(size, np.int64)
    for r in items.groupBy("k").count().collect():  # capacity / unit rows at most
        histogram[r["k"] - 1] = r["count"]
    total = int(histogram.sum())
    intervals, rest_from = plan(histogram)

    n_buckets = total // bucket_rows + 1
    rows = items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(n_buckets)))
    counts = rows.groupBy("k", "bucket").count()
    before = counts.select(F.col("k").alias("bk"), F.col("bucket").alias("bb"), (F.sum("count").over(Window.partitionBy("k").orderBy("bucket")) - F.col("count")).alias("before"))
    rows = rows.withColumn("in_bucket", F.row_number().over(Window.partitionBy("k", "bucket").orderBy("item")) - 1)
    rows = rows.join(before, (F.col("k") == F.col("bk")) & (F.col("bucket") == F.col("bb"))).select("item", "k", (F.col("before") + F.col("in_bucket")).alias("rank"))
    by_class: dict[int, list] = {}
    for k, *rest in intervals:
        by_class.setdefault(k, []).append(rest)
    tables = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in by_class.items()}

    def place(batches):
        for b in batches:
            k, rank = b.column("k").to_numpy(), b.column("rank").to_numpy()
            sequence = np.zeros(len(k), np.int64)
            for c in np.unique(k):
                own = k == c
                first, seq, per, _ = tables[int(c)]
                i = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = seq[i] + (rank[own] - first[i]) // per[i]
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(sequence)], names=["p_item", "sequence_id"])

    placed = rows.mapInArrow(place, "p_item long, sequence_id long")
    placed = bundled.join(placed, F.col("item") == F.col("p_item")).drop("item", "p_item")
    in_order = Window.partitionBy("sequence_id").orderBy("piece")
    placed = placed.withColumn("offset", F.sum("length").over(in_order) - F.col("length"))
    placed = staged.write(placed, "placed")
    full = placed.where(F.col("sequence_id") < rest_from).drop("piece")
    # the remainder: at most a few pieces a pattern, whatever the input's size
    rest = sorted(placed.where(F.col("sequence_id") >= rest_from).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    again = recut(rest, docs, tokenizer_path, end_id, capacity, rest_from)
    for name in ("bundled", "items"):
        staged.drop(name)
    return full.unionByName(spark.createDataFrame(again, full.schema)) if again else full


def recut(rest: list, docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, first_sequence: int) -> list[tuple]:
    by: dict[int, list] = {}
    for i, r in enumerate(rest):
        by.setdefault(r["sequence_id"], []).append((i, r["length"]))
    cut = split_powers([by[k] for k in sorted(by)], capacity, first_sequence)
    moved = {rest[i]["doc_id"] for i, s, n, _, _ in cut if n != rest[i]["length"]}
    ids: dict = {}
    if moved:  # their texts are needed again for the checksums of the new pieces
        wanted = F.col("doc_id").isin([d for d in moved if d is not None])
        texts = docs.where(wanted | F.col("doc_id").isNull() if None in moved else wanted).select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).collect()
        encoder = Encoder.of(tokenizer_path)
        for d, t in texts:
            x = np.append(encoder.encode(t), np.uint32(end_id)).astype("<u4")
            ids.setdefault((d, len(x)), []).append(x)
    out = []
    for i, s, n, sequence, offset in cut:
        r = rest[i]
        crc = r["ids_crc32"]
        if n != r["length"]:
            own = next(x for x in ids[r["doc_id"], r["doc_tokens"]] if zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == crc)
            crc = zlib.crc32(own[r["start"] + s : r["start"] + s + n].tobytes())
        out.append((r["doc_id"], r["start"] + s, n, crc, r["doc_tokens"], sequence, offset))
    return out


def op1_pack(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
