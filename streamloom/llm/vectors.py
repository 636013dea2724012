"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors are folded into one node with a weight. Centroids are fitted on a bounded sample (`sample_rows` rows a length,
`model_bytes` in all); every node joins the shards of its `overlap` nearest centroids. Shards that hold more than three times
`shard_rows` are split before anything is gathered in a task: centroids of their own are fitted on a bounded
sample of each, all shards at once, and every node goes to the nearest two, until no shard is too large. Vectors of a length
that few rows have form one shard without centroids. In a shard the nearest neighbours of each node are its candidates,
and robust pruning keeps those that no kept neighbour is much closer to; the adjacency lists of a node from all its shards
are united. Then every node is a query: in each of its shards (and the next nearest ones, `probes` in all) a greedy beam search
from the shard's medoid, from the query itself where it is a member, and from a node of each part of the graph that no edge
leads into (`entries`: all nodes can be reached from these) finds the query's surroundings. The search expands to all members that
edges or other finds within the threshold connect with these, in matrix products: cosines in double precision decide. No pair
leaves its shard: links are counted there, each pair in the smallest of the shards that can see it (its nodes know where they are),
and a node's connection goes out as one edge to the first node of its component. What a shard gives is bounded by its rows.

`audit` measures recall against brute force for the queries whose id is divisible by 20.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different
lengths do not link; rows that repeat a vector are links of each other, whatever their ids; null vec_id sorts first and stays
null, as does the component_id of its group; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import Staged, id_or_null, id_order, table
from streamloom.llm.links import components
from streamloom.llm.windows import mixed

THRESHOLD = 0.9
#: what single precision may be off by
SLACK = 1e-5


def nodes_of(vectors: DataFrame, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """Rows (id, rid, v1, v2: hashes of usable vectors) and nodes (node, weight, v: unit vector in double precision)."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(id_order("vec_id").alias("id"), F.when(F.coalesce(usable, F.lit(False)), v).alias("v"))
    rows = staged.write(rows.select("*", F.xxhash64("v").alias("v1"), F.xxhash64("v", F.lit(5)).alias("v2"), F.monotonically_increasing_id().alias("rid")), "rows")
    firsts = rows.where("v IS NOT NULL").groupBy("v1", "v2").agg(F.min(F.struct("id", "rid")).alias("first"), F.count("*").alias("weight"))
    firsts = firsts.select("v1", "v2", F.col("first.id").alias("node_id"), F.col("first.rid").alias("node"), "weight")
    firsts = staged.write(firsts, "firsts")
    nodes = rows.select("rid", "v").join(firsts.select("node", "weight").hint("merge"), F.col("rid") == F.col("node")).select("node", "weight", "v")
    return rows, staged.write(nodes, "nodes")


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        centers = np.where((norm > 0)[:, None], sums / np.maximum(norm, 1e-300)[:, None], centers)
    return centers


def neighbours(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """The k nearest others of each row, nearest first."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), block):
        near = x[i : i + block] @ x.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -9
        some = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(near), 0), np.int64)
        out[i : i + block] = np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
    return out


def robust_prune(x: np.ndarray, candidates: np.ndarray, degree: int, alpha: float, block: int = 256) -> list[np.ndarray]:
    """See pruned; a block of rows at a time, so that the gathered candidates take bounded room."""
    return [c for i in range(0, len(x), block) for c in pruned(x, np.arange(i, min(i + block, len(x))), candidates[i : i + block], degree, alpha)]


def pruned(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    """Of each row's candidates those kept: a kept one drops later ones that are alpha times closer to it than to the row."""
    near = x[candidates] if candidates.size else np.zeros((*candidates.shape, x.shape[1]))
    dist = 1 - np.matmul(near, x[own][:, :, None])[:, :, 0]
    alive, kept = np.ones(candidates.shape, bool), np.zeros(candidates.shape, bool)
    rows = np.arange(len(own))
    for _ in range(min(degree, candidates.shape[1])):
        has = alive.any(axis=1)
        if not has.any():
            break
        pick = alive.argmax(axis=1)  # nearest that is left
        kept[rows[has], pick[has]] = True
        between = 1 - np.matmul(near, near[rows, pick][:, :, None])[:, :, 0]
        alive &= ~(has[:, None] & (alpha * between <= dist))
        alive[rows, pick] = False
    return [c[k] for c, k in zip(candidates, kept)]


def reached(graph: np.ndarray, seen: np.ndarray, at: np.ndarray) -> None:
    """Marks in seen all nodes that paths from the nodes `at` lead to."""
    seen[at] = True
    while len(at):
        near = np.unique(graph[at])
        at = near[near >= 0]
        at = at[~seen[at]]
        seen[at] = True


def entries(graph: np.ndarray, medoid: int) -> np.ndarray:
    """The medoid and further nodes, so that every node can be reached from one of them. graph: see beam_search."""
    n = len(graph)
    seen, starts = np.zeros(n, bool), []
    reached(graph, seen, np.array([medoid]))
    while not seen.all():
        starts.append(int(np.argmin(seen)))
        reached(graph, seen, np.array([starts[-1]]))
    # those that a later one reaches are not needed
    seen[:], kept = False, []
    reached(graph, seen, np.array([medoid]))
    for s in reversed(starts):
        if not seen[s]:
            kept.append(s)
            reached(graph, seen, np.array([s]))
    return np.array([medoid, *kept])


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, threshold: float, region: np.ndarray, own: np.ndarray | None = None, beam: int = 32, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(query row, region) pairs: the regions of nodes (see `regions`) in which the beam meets a node within the threshold.
    graph: node x degree, -1 where there is no edge; starts: nodes that every query starts from; own: of each query the node
    that it is, or -1. The walk is in single precision, with a slack; what it finds is verified later."""
    found = [np.zeros(0, np.int64)]
    n = len(x)
    x, slack = x.astype(np.float32), threshold - SLACK
    width = beam + len(starts)
    for i in range(0, len(queries), block):
        q = queries[i : i + block].astype(np.float32)
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True  # stands for "no edge"
        first = np.tile(starts, (len(q), 1))
        if own is not None:
            mine = own[i : i + block, None]
            first = np.concatenate([first, np.where((mine < 0) | (first == mine).any(axis=1, keepdims=True), n, mine)], axis=1)
        is_node = first < n
        seen[rows[:, None], first] = True
        k = first.shape[1]
        pool = np.full((len(q), max(width, k)), -1)
        worth = np.full(pool.shape, -9, np.float32)
        open_ = np.zeros(pool.shape, bool)
        pool[:, :k] = np.where(is_node, first, -1)
        worth[:, :k] = np.where(is_node, np.einsum("qd,qkd->qk", q, x[np.minimum(first, n - 1)]), -9)
        open_[:, :k] = is_node
        a, b = np.nonzero(is_node & (worth[:, :k] >= slack))
        hits = [a * n + region[first[a, b]]]
        while open_.any():
            best = np.where(open_, worth, -99).argmax(axis=1)
            live = np.flatnonzero(open_[rows, best])
            at = pool[live, best[live]]
            open_[live, best[live]] = False
            near = graph[at]
            near = np.where(near < 0, n, near)
            new = ~seen[live[:, None], near]
            some = new.any(axis=1)
            if not some.any():
                continue
            live, near, new = live[some], near[some], new[some]
            seen[live[:, None], near] = True
            a, b = np.nonzero(new)
            value = np.full(near.shape, -9, np.float32)
            value[a, b] = np.einsum("nd,nd->n", q[live[a]], x[near[a, b]])
            a, b = np.nonzero(value >= slack)
            hits.append(live[a] * n + region[near[a, b]])
            joined = np.concatenate([worth[live], value], axis=1)
            top = np.argpartition(-joined, worth.shape[1] - 1, axis=1)[:, : worth.shape[1]]
            pool[live] = np.take_along_axis(np.concatenate([pool[live], near], axis=1), top, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], value > -9], axis=1), top, 1)
            worth[live] = np.take_along_axis(joined, top, 1)
        # a family gives each query one region, not all its members
        found.append(np.unique(np.concatenate(hits)) + i * n)
    return np.divmod(np.concatenate(found), n)


def regions(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes the smallest one that it is connected with by the edges a, b."""
    label = np.arange(n)
    while True:
        low, old = np.minimum(label[a], label[b]), label.copy()
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == old).all():
            return label


def reach(linked: np.ndarray) -> np.ndarray:
    """Of each node the first one that it is connected with, by a matrix of links."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] < 0:
            at = np.array([i])
            while len(at):
                label[at] = i
                at = np.flatnonzero(linked[at].any(axis=0) & (label < 0))
    return label


def columns_below(t: pa.Table, name: str, known: np.ndarray) -> np.ndarray:
    """Rows x known shards: whether the list `name` of the row has the shard."""
    column = t.column(name).combine_chunks()
    flat, row = pc.list_flatten(column).to_numpy(zero_copy_only=False), pc.list_parent_indices(column).to_numpy()
    out = np.zeros((t.num_rows, len(known)), bool)
    if len(known):
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        ok = known[at] == flat
        out[row[ok], at[ok]] = True
    return out


def search_shard(t: pa.Table, threshold: float) -> pa.Table:
    """FOUND of one shard (or of one part of its other queries: see links)."""
    member = t.column("member").to_numpy(zero_copy_only=False).astype(bool)
    if not member.any():
        return pa.table({c: pa.array([], pa.int64()) for c in ("a", "n", "w", "b")})
    t = t.take(pa.array(np.argsort(~member, kind="stable")))  # members first
    x, ids, weight, first_part = matrix(t.column("v")), t.column("node").to_numpy(), t.column("weight").to_numpy(), t.column("part")[0].as_py() == 0
    m = int(member.sum())
    inside, near = x[:m], t.column("near").slice(0, m).combine_chunks()
    # edges between members
    order = np.argsort(ids[:m])
    to, from_ = pc.list_flatten(near).to_numpy(zero_copy_only=False), pc.list_parent_indices(near).to_numpy().astype(np.int64)
    at = order[np.minimum(np.searchsorted(ids[:m][order], to), m - 1)]
    from_, to = from_[ids[at] == to], at[ids[at] == to]
    counts = np.bincount(from_, minlength=m)
    graph = np.full((m, max(1, int(counts.max()))), -1)
    graph[from_, np.arange(len(from_)) - np.repeat(np.cumsum(counts) - counts, counts)] = to
    # range expansion: members connected by edges or by what was found are compared with all of their region, exactly
    close = np.concatenate([np.einsum("nd,nd->n", inside[from_[i : i + 20000]], inside[to[i : i + 20000]]) >= threshold - SLACK for i in range(0, len(to), 20000)] or [np.zeros(0, bool)])
    region = regions(m, from_[close], to[close])
    medoid = int((inside @ inside.mean(axis=0)).argmax())
    asked = np.arange(0 if first_part else m, len(x))
    q, hit = beam_search(inside, graph, entries(graph, medoid), x[asked], threshold, region, np.where(asked < m, asked, -1))
    q = asked[q]
    region = regions(m, np.concatenate([np.arange(m), q[q < m]]), np.concatenate([region, hit[q < m]]))
    by_region = np.argsort(region, kind="stable")
    begin = np.flatnonzero(np.diff(region[by_region], prepend=-1))
    # other queries of each region
    other = np.unique(region[hit[q >= m]] * len(x) + q[q >= m])
    other_begin = np.searchsorted(other, region[by_region[begin]] * len(x))
    other_end = np.searchsorted(other, (region[by_region[begin]] + 1) * len(x))
    # a pair that several shards can see is counted in the smallest of them
    lists = [pc.list_flatten(t.column(c).combine_chunks()).to_numpy(zero_copy_only=False) for c in ("placed", "homes")]
    known = np.unique(np.concatenate(lists))
    known = known[known < t.column("shard")[0].as_py()]
    placed, homes = columns_below(t, "placed", known), columns_below(t, "homes", known)

    def elsewhere(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        use = np.flatnonzero(placed[a].any(axis=0) & placed[b].any(axis=0))
        pa_, ha, pb, hb = (y[np.ix_(r, use)].astype(np.float32) for y, r in ((placed, a), (homes, a), (placed, b), (homes, b)))
        return pa_ @ hb.T + ha @ pb.T > 0

    n, w, edges = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), []
    for lo, hi, q_lo, q_hi in zip(begin, [*begin[1:], m], other_begin, other_end):
        own = by_region[lo:hi]
        if len(own) < 2 and q_lo == q_hi:
            continue
        linked = np.zeros((len(own), len(own)), bool)
        for i in range(0, len(own), 512):
            linked[i : i + 512] = inside[own[i : i + 512]] @ inside[own].T >= threshold
        linked = np.triu(linked, 1)
        linked |= linked.T
        root = own[reach(linked)]
        if first_part:
            for i in range(0, len(own), 512):
                counted = linked[i : i + 512] & ~elsewhere(own[i : i + 512], own)
                n[own[i : i + 512]] += counted.sum(axis=1)
                w[own[i : i + 512]] += counted @ weight[own]
            edges.append(np.stack([own, root], 1)[own != root])
        for i in range(q_lo, q_hi, 512):
            asks = other[i : min(i + 512, q_hi)] % len(x)
            linked = x[asks] @ inside[own].T >= threshold
            counted = linked & ~elsewhere(asks, own)
            n[asks] += counted.sum(axis=1)
            w[asks] += counted @ weight[own]
            n[own] += counted.sum(axis=0)
            w[own] += weight[asks] @ counted
            a, b = np.nonzero(linked)
            edges.append(np.unique(np.stack([asks[a], root[b]], 1), axis=0))
    a, b = np.concatenate([np.zeros((0, 2), np.int64), *edges]).T
    some, none = np.flatnonzero(n), np.zeros(len(a), np.int64)
    return pa.table({"a": np.concatenate([ids[some], ids[a]]), "n": np.concatenate([n[some], none]), "w": np.concatenate([w[some], none]), "b": np.concatenate([ids[some], ids[b]])})


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)) if len(flat) else np.zeros((0, 1))


def by_length(b: pa.RecordBatch):
    """The rows of a batch for each length of v."""
    dims = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), b.filter(pa.array(dims == dim))


PLACED = "shard long, member boolean, node long, v array<double>"
#: links of a that are counted here (nodes, and their weights); b: a node that a is connected with, or a itself
FOUND = "a long, n long, w long, b long"


def split_shards(placed: DataFrame, staged: Staged, shard_rows: int, sample_rows: int, seed: int) -> DataFrame | None:
    """placed with all shards split that hold more than three times shard_rows members; None if there are none."""
    sizes = staged.write(placed.where("member").groupBy(F.col("shard").alias("s_shard")).agg(F.count("*").alias("size")).where(F.col("size") > 3 * shard_rows), f"large-{seed}")
    if sizes.isEmpty():
        return None
    large = placed.join(sizes.hint("merge"), F.col("shard") == F.col("s_shard")).drop("s_shard")
    h = F.xxhash64("node", F.lit(seed))
    some = large.where("member").where(F.shiftrightunsigned(h, 11) * F.lit(2.0**-53) < F.lit(float(sample_rows)) / F.col("size"))

    def fit(t: pa.Table) -> pa.Table:
        x, size = matrix(t.column("v")), t.column("size")[0].as_py()
        centers = k_means(x, min(max(4, -(-size // shard_rows)), max(4, len(x) // 8)))
        return pa.table({"c_shard": pa.array([t.column("shard")[0].as_py()]), "centers": pa.array([centers.ravel().tolist()], pa.list_(pa.float64()))})

    centers = some.select("shard", "size", "v").groupBy("shard").applyInArrow(fit, "c_shard long, centers array<double>")
    # the nodes of a shard are dealt out, and its centroids go to each part
    n_parts = F.ceil(F.col("size") / sample_rows).cast("int")
    centers = centers.join(sizes.hint("merge"), F.col("c_shard") == F.col("s_shard")).withColumn("c_part", F.explode(F.sequence(F.lit(0), n_parts - 1))).select("c_shard", "c_part", "centers")
    dealt = large.select("shard", F.pmod(F.xxhash64("node"), n_parts).cast("int").alias("part"), "member", "node", "v")

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "member": pa.array([], pa.bool_()), "node": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64()))})
        x = matrix(left.column("v"))
        two = np.argsort(-(x @ np.array(right.column("centers")[0].as_py()).reshape(-1, x.shape[1]).T), axis=1, kind="stable")[:, :2]
        rep = left.take(pa.array(np.repeat(np.arange(len(x)), two.shape[1])))
        own = mixed(np.repeat(left.column("shard").to_numpy(), two.shape[1]).view(np.uint64) + (two.ravel() + 1).astype(np.uint64))
        return pa.table({"shard": pa.array(own.view(np.int64)), "member": rep.column("member"), "node": rep.column("node"), "v": rep.column("v")})

    split = dealt.groupBy("shard", "part").cogroup(centers.groupBy("c_shard", "c_part")).applyInArrow(assign, PLACED)
    # a node that comes to a shard by two ways is there once, as a member if either way says so
    split = split.groupBy("shard", "node").agg(F.max("member").alias("member"), F.first("v").alias("v")).select("shard", "member", "node", "v")
    rest = placed.join(sizes.hint("merge"), F.col("shard") == F.col("s_shard"), "left_anti")
    return staged.write(rest.unionByName(split), f"split-{seed}")


def links(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = 1500, overlap: int = 3, probes: int = 4, sample_rows: int = 20000, model_bytes: int = 32 << 20, degree: int = 24, alpha: float = 1.2, staged: Staged | None = None):
    """Rows and first rows of the vectors of a table (see nodes_of); links of each node that has some (d_node; n: nodes, linked:
    their weights); edges (a, b) that connect what links connect, a few for each node."""
    spark = vectors.sparkSession
    staged = staged or Staged(spark, "vectors")
    rows, nodes = nodes_of(vectors, staged)
    # lengths that fill several shards: fewer than there are shards
    counts = {r["dim"]: r["count"] for r in nodes.groupBy(F.size("v").alias("dim")).count().where(F.col("count") > 2 * shard_rows).collect()}
    centers: dict[int, np.ndarray] = {}
    for dim, n in counts.items():
        k = int(max(2, min(round(n / shard_rows), sample_rows // 8, model_bytes // (8 * dim * len(counts)))))
        some = nodes.where(F.size("v") == dim).select("v", F.xxhash64("node").alias("h")).orderBy("h").limit(sample_rows)

        def fit_one(batches, k=k):  # in a task: the driver does no linear algebra
            x = matrix(pa.Table.from_batches(list(batches)).column("v"))
            yield pa.RecordBatch.from_arrays([pa.array([k_means(x, k).ravel().tolist()], pa.list_(pa.float64()))], names=["centers"])

        centers[dim] = np.array(some.mapInArrow(fit_one, "centers array<double>").first()["centers"]).reshape(-1, dim)
    model = spark.sparkContext.broadcast(centers)  # model_bytes at most

    def assign(batches):
        for whole in batches:
            for dim, own in by_length(whole):
                if dim in model.value:
                    near = matrix(own.column("v")) @ model.value[dim].T
                    order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                else:
                    order = np.zeros((len(own), 1), np.int64)
                n = order.shape[1]
                rep = own.take(pa.array(np.repeat(np.arange(len(own)), n)))
                yield pa.RecordBatch.from_arrays([pa.array(order.ravel() + (dim << 32)), pa.array(np.tile(np.arange(n) < overlap, len(own))), rep.column("node"), rep.column("v")], names=["shard", "member", "node", "v"])

    placed = staged.write(nodes.mapInArrow(assign, PLACED), "placed")
    for level in range(1, 64):
        split = split_shards(placed, staged, shard_rows, sample_rows, level)
        if split is None:
            break
        placed = split

    def build(t: pa.Table) -> pa.Table:
        x, ids = matrix(t.column("v")), t.column("node").to_numpy()
        if len(x) < 2:
            return pa.table({"node": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.int64()))})
        kept = robust_prune(x, neighbours(x, 2 * degree), degree, alpha)
        # edges both ways; of many that lead to a node it answers the nearest ones
        from_, to = np.repeat(np.arange(len(x)), [len(c) for c in kept]), np.concatenate(kept)
        order = np.lexsort((-np.einsum("nd,nd->n", x[from_], x[to]), to))
        back = np.split(from_[order], np.cumsum(np.bincount(to, minlength=len(x)))[:-1])
        near = [ids[np.union1d(c, b[: 2 * degree])] for c, b in zip(kept, back)]
        return pa.table({"node": pa.array(ids), "near": pa.array(near, pa.list_(pa.int64()))})

    lists = placed.where("member").groupBy("shard").applyInArrow(build, "node long, near array<long>")
    graph = staged.write(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).withColumnRenamed("node", "g_node"), "graph")

    # where else a node is; the queries of a shard that are no members are dealt out in parts, each with all members
    size = F.count_if(~F.col("member"))
    parts = staged.write(placed.groupBy(F.col("shard").alias("p_shard")).agg(F.ceil(size / (3 * shard_rows)).cast("int").alias("parts")).where("parts > 1"), "parts")
    where = placed.groupBy(F.col("node").alias("w_node")).agg(F.collect_list("shard").alias("placed"), F.collect_list(F.when(F.col("member"), F.col("shard"))).alias("homes"))
    weights = staged.spark.read.parquet(f"{staged.root}/firsts").select(F.col("node").alias("f_node"), "weight")
    where = where.join(weights.hint("merge"), F.col("w_node") == F.col("f_node")).join(graph.hint("merge"), F.col("w_node") == F.col("g_node"), "left")
    near = F.when(F.col("member"), F.coalesce("near", F.array().cast("array<long>")))
    searched = placed.join(where.hint("merge"), F.col("node") == F.col("w_node")).select("shard", "member", "node", "v", "weight", "placed", "homes", near.alias("near"))
    dealt = F.when(F.col("member"), F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")))
    searched = searched.join(parts.hint("merge"), F.col("shard") == F.col("p_shard"), "left").withColumn("part", F.explode(dealt)).drop("parts", "p_shard")
    found = staged.write(searched.groupBy("shard", "part").applyInArrow(lambda t: search_shard(t, threshold), FOUND), "found")
    counts = found.groupBy(F.col("a").alias("d_node")).agg(F.sum("n").alias("n"), F.sum("w").alias("linked"))
    return rows, staged.spark.read.parquet(f"{staged.root}/firsts"), counts, found.where("a <> b").select("a", "b"), staged


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id, kept for each row of vectors."""
    rows, firsts, direct, edges, staged = links(vectors, threshold, **settings)
    labels = components(edges, staged)
    known = firsts.join(labels.select(F.col("node").alias("l_node"), "label").hint("merge"), F.col("node") == F.col("l_node"), "left").withColumn("label", F.coalesce("label", "node")).drop("l_node")
    least = known.groupBy(F.col("label").alias("m_label")).agg(F.min("node_id").alias("component"))
    known = known.join(least.hint("merge"), F.col("label") == F.col("m_label")).join(direct.hint("merge"), F.col("node") == F.col("d_node"), "left")
    known = known.select(F.col("v1").alias("k1"), F.col("v2").alias("k2"), "component", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(known.hint("merge"), F.col("v").isNotNull() & (F.col("v1") == F.col("k1")) & (F.col("v2") == F.col("k2")), "left")
    component = F.coalesce("component", "id")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), (component == F.col("id")).alias("kept"))
    return out.select(id_or_null("id").alias("vec_id"), "n_links", id_or_null("component").alias("component_id"), "kept")


def audit(vectors: DataFrame, threshold: float = THRESHOLD, **settings) -> tuple[int, int]:
    """Links found and links there are, of the queries whose id is divisible by 20, by brute force in blocks."""
    rows, firsts, counts, edges, staged = links(vectors, threshold, **settings)
    nodes = staged.spark.read.parquet(f"{staged.root}/nodes")
    asked = firsts.where("node_id % 20 = 0").select(F.col("node").alias("a"))
    found = counts.join(asked, F.col("d_node") == F.col("a")).agg(F.sum("n")).first()[0] or 0
    queries = nodes.join(asked, F.col("node") == F.col("a")).select("node", "v")
    there = 0
    for dim, n in [(r["dim"], r["count"]) for r in queries.groupBy(F.size("v").alias("dim")).count().collect()]:
        own, all_own = (x.where(F.size("v") == dim).select("node", "v") for x in (queries, nodes))
        for block in range(0, n, 2000):  # a stated query set against all rows, a block at a time
            part = own.orderBy("node").offset(block).limit(2000).toArrow()
            q, ids = matrix(part.column("v")), part.column("node").to_numpy()

            def count(batches, q=q, ids=ids):
                for b in batches:
                    near = matrix(b.column("v")) @ q.T >= threshold
                    yield pa.RecordBatch.from_arrays([pa.array([int((near & (b.column("node").to_numpy()[:, None] != ids)).sum())])], names=["n"])

            there += all_own.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    return found, there


def op9_near_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP9_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS label FROM v UNION SELECT l.b, r.label FROM r JOIN l ON l.a = r.node WHERE r.label < l.b),
c AS (SELECT node, min(label) AS label FROM r GROUP BY 1)
SELECT node AS vec_id, (SELECT count(*) FROM l WHERE l.a = node) AS n_links, label AS component_id, node = label AS kept FROM c
"""
