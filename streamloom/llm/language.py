"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are lower-cased and runs of anything but letters and marks become one space. The models of order `ORDER` are fitted on
at most `train_docs` labelled documents of each language (those with the smallest hashes of doc_id; whole texts), of every label
that occurs (more than `max_languages` are an error); the rest of the work covers every document. The models of all languages share sorted arrays
of 64-bit n-gram hashes for each order, with a row of log probabilities (a column for each language), and sorted arrays
of context hashes with the log weights that lead to the next lower order. A document gets the language of the lowest
cross-entropy per character.

Rejection is calibrated on the fifth of the sample that the fit leaves out, for each language by itself (for languages of which
it holds fewer than `least_rest` documents, on all together): the excess of a document of n characters is its cross-entropy less the
language's mean, in units of 1 / sqrt(n), and the bound is `slack` times the `quantile` of the excess. A document is
rejected if it exceeds that of its best language and also `least_ratio` times the mean (texts that mix two known languages come to
about 1.5 times).

Defined cases: null text or a text without a letter is `und` with score 0 and rejected; null labels are not learned from;
without any labelled document everything is `und`; equal rows are judged alike; null doc_id counts as the text "" for
the held-out test; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamloom.llm.common import slices, table

ORDER = 4
UNKNOWN = "und"
#: letters, and marks, which are parts of words in many scripts
NOT_LETTERS, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CHUNK_CHARS = 1 << 17


def normal(text: str) -> str:
    """Empty where there is no letter (Unicode category L)."""
    text = NOT_LETTERS.sub(" ", text.lower()).strip()
    return text if LETTER.search(text) else ""


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 spaces and before one; and where the scored places of each begin and end."""
    pad = " " * (ORDER - 1)
    joined = "".join(f"{pad}{t} " for t in texts)
    ends = np.cumsum([len(t) + ORDER for t in texts]) if texts else np.zeros(0, np.int64)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), ends.astype(np.int64)


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each place n - 1, n, ..."""
    size = len(codes) - n + 1
    h = np.zeros(max(size, 0), np.uint64)
    for k in range(n):
        h *= MULTIPLIER
        h += codes[k : k + size].astype(np.uint64) + np.uint64(1)
    return h


def row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = h * MULTIPLIER + rows[:, k].astype(np.uint64) + np.uint64(1)
    return h


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (rows of code points) of the texts and their counts."""
    codes, ends = codes_of(texts)
    if not len(codes):
        return np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
    h = hashes(codes, ORDER)
    at = np.arange(len(h)) + ORDER - 1  # place of the last code point
    start = np.concatenate([[0], ends[:-1]])
    own = at - start[np.searchsorted(ends, at, "right")] >= ORDER - 1
    h, first = h[own], np.flatnonzero(own)
    _, index, counts = np.unique(h, return_index=True, return_counts=True)
    rows = np.stack([codes[first[index] + k] for k in range(ORDER)], 1)
    return rows, counts


def suffixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows without their first column, and of how many rows each is the rest: continuation counts."""
    _, index, counts = np.unique(row_hashes(rows[:, 1:]), return_index=True, return_counts=True)
    return rows[index, 1:], counts


def find(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return i, table_[i] == keys


class Models:
    """grams[k], logs[k]: sorted hashes of the k-grams of any language and log probabilities; contexts[k], backs[k]: those of the
    contexts of k-grams and the log weights of order k - 1."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        n_lang = len(self.names)
        if not n_lang:
            return
        levels = {k: [] for k in range(1, ORDER + 1)}
        for name in self.names:
            rows, counts = grams_of(texts[name])
            for k in range(ORDER, 0, -1):
                levels[k].append((rows, counts))
                if k > 1:
                    rows, counts = suffixes(rows)
        letters = np.unique(np.concatenate([r[:, 0] for r, _ in levels[1]]))
        lower_p, lower_keys = None, None
        self.grams, self.logs, self.contexts, self.backs = {}, {}, {}, {}
        for k in range(1, ORDER + 1):
            rows = np.concatenate([r for r, _ in levels[k]])
            keys, index = np.unique(row_hashes(rows), return_index=True)
            rows = rows[index]
            below = np.full((len(keys), n_lang), 1.0 / (len(letters) + 1)) if k == 1 else lower_p[np.searchsorted(lower_keys, row_hashes(rows[:, 1:]))]
            context = row_hashes(rows[:, :-1])
            context_keys = np.unique(context)
            back = np.ones((len(context_keys), n_lang))
            p = np.empty((len(keys), n_lang))
            for i, (own, counts) in enumerate(levels[k]):
                ones, twos = (counts == 1).sum(), (counts == 2).sum()
                discount = ones / (ones + 2 * twos) if ones and twos else 0.5
                place = np.searchsorted(context_keys, row_hashes(own[:, :-1]))
                total, kinds = np.bincount(place, counts, len(context_keys)), np.bincount(place, minlength=len(context_keys))
                back[:, i] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, row_hashes(own))] = np.maximum(counts - discount, 0)
                at = np.searchsorted(context_keys, context)
                p[:, i] = c / np.maximum(total[at], 1) + back[at, i] * below[:, i]
            self.grams[k], self.logs[k] = keys, np.log(p).astype(np.float32)
            self.contexts[k], self.backs[k] = context_keys, np.log(back).astype(np.float32)
            lower_p, lower_keys = p, keys
            if k == 1:
                self.floor = np.log(back[0] / (len(letters) + 1))

    def place_logs(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of the code points at places ORDER - 1, ... given those before, a column for each language."""
        n = len(codes) - ORDER + 1
        out = np.zeros((n, len(self.names)), np.float32)
        left = np.arange(n)
        for k in range(ORDER, 0, -1):
            if k == ORDER:
                h, c = hashes(codes, k), hashes(codes[:-1], k - 1)
            else:
                window = codes[left[:, None] + np.arange(ORDER - k, ORDER)]
                h, c = row_hashes(window), row_hashes(window[:, :-1])
            i, hit = find(self.grams[k], h)
            out[left[hit]] += self.logs[k][i[hit]]
            left, c = left[~hit], c[~hit]
            if not len(left):
                return out
            if k > 1:
                i, known = find(self.contexts[k], c)
                out[left[known]] += self.backs[k][i[known]]
        out[left] += self.floor.astype(np.float32)
        return out

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities (text x language) and the number of places of each normalised text."""
        sums, n = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64)
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_CHARS):
                size += len(texts[j])
                j += 1
            for at, part in enumerate(texts[i:j], i):
                n[at] = len(part) + 1
            if size <= 2 * CHUNK_CHARS:
                codes, ends = codes_of(texts[i:j])
                logs = self.place_logs(codes)
                start = np.concatenate([[0], ends[:-1]])
                for a, b, at in zip(start, ends, range(i, j)):
                    sums[at] = logs[a : b - ORDER + 1].sum(axis=0, dtype=np.float64)
            else:  # one very long text, in overlapping parts
                codes, _ = codes_of([texts[i]])
                for a in range(0, len(codes) - ORDER + 1, CHUNK_CHARS):
                    sums[i] += self.place_logs(codes[a : a + CHUNK_CHARS + ORDER - 1]).sum(axis=0, dtype=np.float64)
            i = j
        return sums, n


class Detector:
    def __init__(self, texts: dict[str, list[str]], slack: float = 2.0, least_ratio: float = 1.75, quantile: float = 0.99, least_rest: int = 20):
        left_out = lambda v: {i for i in range(len(v)) if i % 5 == 4 and len(v) >= 10}
        fit = {k: [t for i, t in enumerate(v) if t and i not in left_out(v)] for k, v in texts.items()}
        self.models = Models({k: v for k, v in fit.items() if v})
        self.slack, self.ratio = slack, least_ratio
        names = self.models.names
        rest = [(t, names.index(k)) for k, v in texts.items() if fit[k] for i, t in enumerate(v) if t and i in left_out(v)]
        if not rest:  # small labels only: their own documents, which looks better than it is
            rest = [(t, names.index(k)) for k, v in fit.items() for t in v]
        self.mean, self.bound = np.zeros(len(names)), np.zeros(len(names))
        if not rest:
            return
        sums, n = self.models.scores([t for t, _ in rest])
        own = np.array([i for _, i in rest])
        entropy = -sums.max(axis=1) / n

        def calibrated(part):
            mean = float(np.average(entropy[part], weights=n[part]))
            return mean, max(float(np.quantile((entropy[part] - mean) * np.sqrt(n[part]), quantile)), 0.0)

        everything = calibrated(np.ones(len(own), bool))
        for i in range(len(names)):
            self.mean[i], self.bound[i] = calibrated(own == i) if (own == i).sum() >= least_rest else everything

    def judge(self, raw: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy per character, rejected."""
        texts = [normal(t) if t is not None else "" for t in raw]
        names = self.models.names
        lang, score, entropy, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        some = [i for i, t in enumerate(texts) if t]
        if not some or not names:
            return lang, score, entropy, out
        sums, n = self.models.scores([texts[i] for i in some])
        best = sums.argmax(axis=1)
        e = -sums.max(axis=1) / n
        mean, bound = self.mean[best], self.bound[best]
        far = (e > mean + self.slack * bound / np.sqrt(n)) & (e > self.ratio * mean)
        for i, b in zip(some, best):
            lang[i] = names[b]
        at = np.array(some)
        score[at] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        entropy[at], out[at] = e, far
        return lang, score, entropy, out


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, train_docs: int = 400, max_languages: int = 1000) -> Detector:
    """From labelled rows outside the held-out fold; at most train_docs of each label."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} labels; raise max_languages or clean the labels")
    if not counts:
        return Detector({})
    # the hash lets through about twice what is wanted, so that the exact choice is among few rows
    h = F.xxhash64("doc_id", "text", F.lit(11))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * train_docs / n)))])
    few = rows.where(F.shiftrightunsigned(h, 11) * F.lit(2.0**-53) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    order = Window.partitionBy("lang").orderBy(h, "doc_id", "text")
    chosen = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= train_docs)
    texts: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "n").select("lang", "text").toLocalIterator():
        if t := normal(r["text"]):
            texts.setdefault(r["lang"], []).append(t)
    return Detector(texts)


def identify(docs: DataFrame, detector: Detector, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and lang_pred, score, cross_entropy, rejected, from the column text alone."""
    model = docs.sparkSession.sparkContext.broadcast(detector)  # as large as the bounded sample makes it

    # the text travels once, also where it is wanted back
    sent = {c: "text" if c == "text" and docs.schema[c].dataType == T.StringType() else f"keep_{i}" for i, c in enumerate(keep)}

    def run(batches):
        for b in slices(batches):
            lang, score, entropy, rejected = model.value.judge(b.column("text").to_pylist())
            kept = [b.column(sent[c]) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], names=[*keep, "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select(*[F.col(c).alias(n) for c, n in sent.items() if n != "text"], F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double, cross_entropy double, rejected boolean"
    return rows.mapInArrow(run, schema)


def op5_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
