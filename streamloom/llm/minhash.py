r"""MinHash near-dedup with BagMinHash signatures: weighted Jaccard similarity of five-word shingles of 0.8 or more.

A document is the multiset of its five-word shingles (words: runs of other than \x20 and \x09-\x0D; a shorter document is
one shingle). Each shingle has Poisson processes over the weight axis, cut at 0, 1, 2, 4, 8, ...: a point has a time, a
register and a place on the weight axis, and counts for documents whose weight lies above that place. A register keeps
the earliest time, so two documents agree in a register with the probability of their weighted Jaccard similarity.
Points are drawn in rounds for all shingles of a batch, and a process stops once its time is past all its document's registers.

Signatures of BANDS * ROWS registers are banded; equal texts are folded to one before. In each bucket every document is
compared with one centre c, the one that shares most buckets with others, so a group of copies costs one comparison a document.

Other links of a bucket are found as follows. The rest of a bucket (all but its centre) whose documents are not of one
component yet is left over. Rests of at most `small` documents are compared as they are, each in one task. The documents of all
larger ones go through a prefix join. Both are exact, so the size of a rest decides the work and not the links. In the
prefix join, with the elements of a document of size n in one order for all documents, rarest first, two linked documents
share one of their first n - ceil(s n) + 1 elements (s: the threshold). Documents are bucketed by these; elements that only one
document has are passed over, and the documents of one component that share an element travel as one row. A bucket of
several components is dealt out in pairs of blocks, the documents of its most common component against the others and the
others among themselves, so no task holds more than two blocks. How often elements occur is counted in SLOTS hashed
counters of a byte; a collision changes the order, and so the work, but not the links.

Defined cases: null text has no shingle; documents without words link with nothing; rows that repeat a document are
copies of each other; null doc_id sorts first and stays null, as does the component_id of its group; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import Staged, id_or_null, id_order, slices, table, text_or_empty, width
from streamloom.llm.links import components
from streamloom.llm.windows import Hashes, chunks, mixed, text_bytes, word_tokens

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 4
SLOTS = 1 << 20
MARK = 0x5851F42D4C957F2D


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted) and their counts."""
    words = word_tokens(text_bytes(text))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(Hashes(words).grams(min(SHINGLE, len(words))), return_counts=True)


def elements(text: str) -> np.ndarray:
    """The multiset as a sorted set: the j-th copy of a shingle is an element of its own."""
    found, counts = shingles(text)
    if len(found) == counts.sum():
        return found
    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(np.repeat(found, counts) + mixed(copy.astype(np.uint64)) * (copy > 0))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets, as elements."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_min_hash(items: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (document x register: earliest time) of weighted items; doc: of each item, ascending."""
    seeds, owner, limit, rate, low = [], [], [], [], []
    level, start = 0, 0
    while True:  # intervals [0, 1), [1, 2), [2, 4), ... of the weight axis
        has = weights > start
        if not has.any():
            break
        size = max(1, start)
        seeds.append(mixed(items[has] + np.array([level], np.uint64) * np.uint64(0xA0761D6478BD642F)))
        owner.append(doc[has])
        limit.append(weights[has])
        rate.append(np.full(has.sum(), float(size)))
        low.append(np.full(has.sum(), start))
        level, start = level + 1, start + size
    sig = np.full((n_docs, m), np.inf)
    if not seeds:
        return sig
    seed, own, limit, rate, low = (np.concatenate(x) for x in (seeds, owner, limit, rate, low))
    time, flat = np.zeros(len(seed)), sig.reshape(-1)
    horizon = np.full(n_docs, np.inf)
    step = 0
    while len(seed):
        step += 1
        first = mixed(seed + np.array([step], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        second = mixed(first ^ np.uint64(0xE7037ED1A0B428DB))
        time = time - np.log(unit(first)) / rate
        live = time < horizon[own]
        seed, own, limit, rate, low, time, second = (x[live] for x in (seed, own, limit, rate, low, time, second))
        if not len(seed):
            break
        register = ((second & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        place = low + np.floor((second >> np.uint64(32)).astype(np.float64) * 2.0**-32 * rate)
        inside = place < limit
        np.minimum.at(flat, own[inside] * m + register[inside], time[inside])
        active = np.unique(own)
        horizon[active] = sig[active].max(axis=1)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    bits = mixed(sig.view(np.uint64)).reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for r in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return h


def signature_rows(docs: DataFrame) -> DataFrame:
    """id, h1, h2 (hashes of the text), bands (none where there is no shingle)."""

    def run(batches):
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            sets = [shingles(t) for t in texts]
            keys = []
            for i, j in chunks([s[0] for s in sets]):
                doc = np.repeat(np.arange(j - i), [len(s[0]) for s in sets[i:j]])
                sig = bag_min_hash(np.concatenate([s[0] for s in sets[i:j]]), np.concatenate([s[1] for s in sets[i:j]]), doc, j - i)
                keys += [k if len(s[0]) else None for k, s in zip(band_keys(sig).view(np.int64), sets[i:j])]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h1"), b.column("h2"), pa.array(keys, pa.list_(pa.int64()))], names=["id", "h1", "h2", "bands"])

    return docs.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(5)).alias("h2")).mapInArrow(run, "id long, h1 long, h2 long, bands array<long>")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """node, center, linked. pairs: node, center; texts: id, text."""
    left = texts.select(F.col("id").alias("n_id"), F.col("text").alias("n_text"))
    right = texts.select(F.col("id").alias("c_id"), F.col("text").alias("c_text"))
    both = pairs.join(left.hint("merge"), F.col("node") == F.col("n_id")).join(right.hint("merge"), F.col("center") == F.col("c_id")).select("node", "center", "n_text", "c_text")

    def run(batches):
        known, last = None, None
        for b in slices(batches):
            linked = []
            for center, text, center_text in zip(*(b.column(c).to_pylist() for c in ("center", "n_text", "c_text"))):
                if last != center:
                    known, last = elements(center_text), center
                linked.append(overlap(elements(text), known) >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("center"), pa.array(linked, pa.bool_())], names=["node", "center", "linked"])

    return both.mapInArrow(run, "node long, center long, linked boolean")


def settled(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links a, b between documents of different components (label) of each bucket g; for buckets of bounded size."""
    joined = members.join(texts.select(F.col("id").alias("t_id"), "text").hint("merge"), F.col("node") == F.col("t_id")).select("g", "node", "label", "text")

    def run(t: pa.Table) -> pa.Table:
        node, label = t.column("node").to_pylist(), t.column("label").to_pylist()
        sets = [elements(x) for x in t.column("text").to_pylist()]
        found = [(node[i], node[j]) for i in range(len(node)) for j in range(i) if label[i] != label[j] and min(len(sets[i]), len(sets[j])) >= THRESHOLD * max(len(sets[i]), len(sets[j])) and overlap(sets[i], sets[j]) >= THRESHOLD]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return joined.groupBy("g").applyInArrow(run, "a long, b long")


def slots(e: np.ndarray) -> np.ndarray:
    return (mixed(e) & np.uint64(SLOTS - 1)).astype(np.int64)


def lists(column) -> list[np.ndarray]:
    """The arrays of a column of element lists."""
    return [np.asarray(x.values, np.int64).view(np.uint64) for x in column]


def rarest_first(e: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The elements of which a linked document has one at least among its own; without those that no other document has."""
    need = int(np.ceil(THRESHOLD * len(e) - 1e-6))
    times = often[slots(e)]
    order = np.lexsort((e, times))[: len(e) - need + 1]
    return e[order[times[order] > 1]]


def counted(counts: list[np.ndarray]) -> pa.RecordBatch:
    """The sum of counts, 255 at most, as a row of one binary."""
    total = np.zeros(SLOTS, np.int64)
    for c in counts:
        total += c
    return pa.RecordBatch.from_arrays([pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()], pa.binary())], names=["counts"])


def joined_by_prefix(left: DataFrame, texts: DataFrame, staged: Staged, block: int = 256) -> DataFrame:
    """Links a, b that connect the components of left (node, label) as all links between their documents do."""
    spark = staged.spark
    with_text = left.join(texts.select(F.col("id").alias("t_id"), "text").hint("merge"), F.col("node") == F.col("t_id")).select("node", "label", "text")

    def read(batches):
        for b in slices(batches):
            found = [elements(t).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), pa.array(found, pa.list_(pa.int64()))], names=["node", "label", "elements"])

    # neighbours in the order of label are of one component; a large component is spread over several ranges
    near = with_text.repartitionByRange(width(spark, 0, 1), "label", "node").sortWithinPartitions("label", "node")
    sets = staged.write(near.mapInArrow(read, "node long, label long, elements array<long>"), "prefix-sets")

    def tally(batches):
        counts = np.zeros(SLOTS, np.int64)
        for b in slices(batches):
            counts += np.bincount(slots(np.concatenate(lists(b.column("elements")))), minlength=SLOTS)
        yield counted([np.minimum(counts, 255).astype(np.uint8)])

    def merge(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([counted([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("counts")])])

    # one row of SLOTS bytes a task, added up in two steps: a group and the driver have about the root of the number of tasks
    n_groups = int(np.sqrt(sets.rdd.getNumPartitions())) + 1
    groups = sets.select("elements").mapInArrow(tally, "counts binary").groupBy(F.pmod(F.spark_partition_id(), F.lit(n_groups))).applyInArrow(merge, "counts binary")
    counts = np.frombuffer(counted([np.frombuffer(x.as_buffer(), np.uint8) for x in groups.toArrow().column("counts")]).column("counts")[0].as_buffer(), np.uint8)
    often = spark.sparkContext.broadcast(counts)

    def cut(batches):
        for b in slices(batches):
            node, label = b.column("node").to_numpy(), b.column("label").to_numpy()
            first = [rarest_first(e, often.value) for e in lists(b.column("elements"))]
            row, g = np.repeat(np.arange(len(first)), [len(x) for x in first]), np.concatenate(first)
            order = np.lexsort((node[row], label[row], g))
            row, g = row[order], g[order]
            own = label[row]
            head = np.flatnonzero(np.concatenate([np.ones(min(len(g), 1), bool), (g[1:] != g[:-1]) | (own[1:] != own[:-1])]))
            nodes = pa.ListArray.from_arrays(pa.array(np.append(head, len(g)).astype(np.int32)), pa.array(node[row]))
            tags = [np.add.reduceat(mixed(node[row].view(np.uint64) ^ np.uint64(t)) >> np.uint64(24), head) if len(g) else g for t in (0, MARK)]
            yield pa.RecordBatch.from_arrays([pa.array(g[head].view(np.int64)), pa.array(own[head]), nodes, *(pa.array(t.view(np.int64)) for t in tags)], names=["g", "label", "nodes", "t1", "t2"])

    by_element = staged.write(sets.mapInArrow(cut, "g long, label long, nodes array<long>, t1 long, t2 long"), "prefix-buckets")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    shares = by_element.groupBy("g", "label").agg(F.sum(F.size("nodes")).alias("n"), total("t1"), total("t2"))
    several = shares.groupBy(F.col("g").alias("s_g")).agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels"), F.sum("t1").alias("t1"), F.sum("t2").alias("t2")).where("labels > 1")
    # one of the buckets that hold the same documents
    several = several.groupBy("size", "t1", "t2").agg(F.min(F.struct("s_g", "most")).alias("b")).select(F.col("b.s_g").alias("s_g"), "size", F.col("b.most.n").alias("n_main"), F.col("b.most.label").alias("main"))
    parts = lambda n: F.ceil(n / block).cast("int")
    met = by_element.join(several.hint("merge"), F.col("g") == F.col("s_g"))
    placed = met.select("g", "label", F.explode("nodes").alias("node"), "main", "n_main", "size").select("g", "node", (F.col("label") == F.col("main")).alias("is_main"), parts(F.col("n_main")).alias("mains"), parts(F.col("size") - F.col("n_main")).alias("others"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    pair = lambda u, v: F.struct(u.cast("int").alias("u"), v.cast("int").alias("v"))
    # a pair of blocks: one of the most common component (from 0) and one of the others, or two of the others (below 0)
    with_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: pair(F.col("own"), j))
    with_mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: pair(i, F.col("own")))
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: pair(-1 - F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    at = F.when(F.col("is_main"), with_others).when(F.col("others") == 1, with_mains).otherwise(F.concat(with_mains, among))
    dealt = placed.withColumn("own", own).select("g", "node", "is_main", F.explode(at).alias("at")).select("g", "node", "is_main", "at.u", "at.v")
    full = dealt.join(sets.select(F.col("node").alias("e_node"), "label", "elements").hint("merge"), F.col("node") == F.col("e_node")).select("g", "u", "v", "node", "is_main", "label", "elements")

    def compare(t: pa.Table) -> pa.Table:
        node, label, is_main = t.column("node").to_numpy(), t.column("label").to_numpy(), t.column("is_main").to_numpy()
        found = lists(t.column("elements"))
        size = np.array([len(e) for e in found])
        starts = np.cumsum(size) - size
        names, flat = np.unique(np.concatenate(found), return_inverse=True)
        has = np.zeros(len(names), bool)
        a, b = [], []
        for x in np.flatnonzero(~is_main):
            mine = flat[starts[x] : starts[x] + size[x]]
            has[mine] = True
            shared = np.add.reduceat(has[flat], starts, dtype=np.int64)
            has[mine] = False
            y = np.flatnonzero((shared / (size + size[x] - shared) >= THRESHOLD) & (label != label[x]))
            y = y[np.unique(label[y], return_index=True)[1]]  # one link to each component
            a += [node[x]] * len(y)
            b += node[y].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return staged.write(full.groupBy("g", "u", "v").applyInArrow(compare, "a long, b long").distinct(), "prefix-links")


def link(members: DataFrame, texts: DataFrame, staged: Staged, small: int = 32) -> DataFrame:
    """node, label of all nodes that are linked. members: g (bucket), node."""
    sizes = members.groupBy(F.col("g").alias("s_g")).agg(F.count("*").alias("size"))
    sized = staged.write(members.join(sizes.hint("merge"), F.col("g") == F.col("s_g")).select("g", "node", "size"), "sized")
    weights = sized.groupBy(F.col("node").alias("w_node")).agg(F.sum("size").alias("weight"))
    weighted = sized.join(weights.hint("merge"), F.col("node") == F.col("w_node"))
    heads = weighted.groupBy(F.col("g").alias("h_g")).agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("head")).select("h_g", (-F.col("head.minus")).alias("center"))
    rest = staged.write(sized.join(heads.hint("merge"), F.col("g") == F.col("h_g")).where("node <> center").select("g", "node", "center"), "rest")
    judged = staged.write(compared(rest.select("node", "center").distinct(), texts), "judged")
    staged.drop("sized")
    links = judged.where("linked").select(F.col("node").alias("a"), F.col("center").alias("b"))
    labels = staged.write(components(links, staged, "cc-centres"), "labels-centres")

    # what the centres leave over: rests of several components
    known = labels.select(F.col("node").alias("l_node"), "label")
    labelled = rest.join(known.hint("merge"), F.col("node") == F.col("l_node"), "left").select("g", "node", F.coalesce("label", "node").alias("label"))
    labelled = staged.write(labelled, "labelled")
    several = labelled.groupBy(F.col("g").alias("s_g")).agg(F.count("*").alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("set")).where("l0 < l1")
    # one of the buckets that hold the same documents
    several = several.groupBy("size", "set").agg(F.min("s_g").alias("s_g"))
    kept = staged.write(labelled.join(several.select("s_g", "size").hint("merge"), F.col("g") == F.col("s_g")).select("g", "node", "label", "size"), "kept")
    for name in ("rest", "labelled"):
        staged.drop(name)
    # the components so far stand for the links that made them
    links = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    links = links.unionByName(staged.write(settled(kept.where(F.col("size") <= small), texts).distinct(), "settled"))
    left = staged.write(kept.where(F.col("size") > small).select("node", "label").distinct(), "left")
    if not left.isEmpty():
        links = links.unionByName(joined_by_prefix(left, texts, staged))
    return staged.write(components(links, staged, "cc-last"), "labels")


def near_duplicates(docs: DataFrame, few: bool = False) -> DataFrame:
    """One row per row of docs: id (NO_ID for null), h1, h2, rid (its number), component_id (smallest id of its group), kept (one of each group).
    few: see Staged."""
    spark = docs.sparkSession
    staged = Staged(spark, "minhash", docs if few else None)
    rows = docs.select(id_order().alias("id"), text_or_empty().alias("text"))
    signed = staged.write(signature_rows(rows).withColumn("rid", F.monotonically_increasing_id()), "signed")
    # equal texts are one class, represented by its first row
    classes = staged.write(signed.where("bands IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("id", "rid")).alias("first")).select("h1", "h2", F.col("first.id").alias("first_id"), F.col("first.rid").alias("node")), "classes")
    nodes = signed.join(classes.select("node").hint("merge"), F.col("rid") == F.col("node")).select("node", F.explode("bands").alias("g"))
    in_band = staged.write(nodes, "bands")
    shared = in_band.groupBy(F.col("g").alias("s_g")).agg(F.count("*").alias("size")).where("size > 1").select("s_g")
    members = staged.write(in_band.join(shared.hint("merge"), F.col("g") == F.col("s_g")).select("g", "node"), "members-0")
    staged.drop("bands")

    # texts of the documents in shared buckets; a row is found by id and both hashes
    wanted = members.select("node").distinct().join(classes.hint("merge"), "node").select("node", F.col("first_id").alias("w_id"), F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    hashed = rows.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(5)).alias("h2"))
    texts = hashed.join(wanted.hint("merge"), (F.col("id") == F.col("w_id")) & (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))).select(F.col("node").alias("id"), "text")
    texts = staged.write(texts.dropDuplicates(["id"]), "texts")

    labels = link(members, texts, staged)

    named = classes.join(labels.select(F.col("node").alias("n"), "label").hint("merge"), F.col("node") == F.col("n"), "left").select("h1", "h2", "first_id", "node", F.coalesce("label", "node").alias("label"))
    heads = named.groupBy("label").agg(F.min(F.struct("first_id", "node")).alias("head"))
    named = named.join(heads.hint("merge"), "label").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("head.first_id").alias("component_id"), F.col("head.node").alias("head_rid"))
    out = signed.join(named.hint("merge"), (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    return out.select("id", "h1", "h2", "rid", F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("head_rid", "rid") == F.col("rid")).alias("kept"))


def without_near_duplicates(docs: DataFrame, few: bool = False) -> DataFrame:
    """The rows of docs that stay: one of each group (and one of rows that repeat a document)."""
    judged = near_duplicates(docs, few).where("kept").select(F.col("id").alias("k_id"), F.col("h1").alias("k1"), F.col("h2").alias("k2")).distinct()
    text = text_or_empty()
    # the row travels as one column, so that no name of it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_order().alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(5)).alias("h2"))
    on = (F.col("id") == F.col("k_id")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    return rows.join(judged.hint("merge"), on, "left_semi").dropDuplicates(["id", "h1", "h2"]).select("row.*")


def op10_minhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"), few=True)
    return out.select(id_or_null("id").alias("doc_id"), id_or_null("component_id").alias("component_id"), "kept")


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
e AS (SELECT doc_id, k, count(*) AS c FROM s GROUP BY 1, 2),
n AS (SELECT doc_id, sum(c) AS n FROM e GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS met FROM e a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE met / (na.n + nb.n - met) >= 0.8),
r AS (SELECT doc_id AS node, doc_id AS label FROM d UNION SELECT l.b, r.label FROM r JOIN l ON l.a = r.node WHERE r.label < l.b)
SELECT node AS doc_id, min(label) AS component_id, node = min(label) AS kept FROM r GROUP BY node
"""
