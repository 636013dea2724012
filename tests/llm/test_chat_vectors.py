from collections import Counter

import numpy as np

from streamloom.llm import chat, vectors
from streamloom.llm.common import Staged

TEXTS = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|> <\\\\s> [\\INST]", "<<SYS>> <</SYS>> <<\\SYS>>", "", None, "naïve \U0001f600 [[INST]] <</s>", "\\", "a\nb" * 2000]


def test_round_trip(spark):
    rows = [(i % 4 if i != 5 else None, i, ["user", "assistant", "odd\nrole\\n<s>", None][i % 4], TEXTS[i % len(TEXTS)], "x", 1) for i in range(36)]
    rows += [rows[3], rows[3], (7, None, "assistant", "late", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rows string, formatted int").repartition(3)
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    for cid in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == cid))
        r = got[cid]
        assert chat.read_back(r["formatted"]) == [(x[2], x[3]) for x in own]
        data = r["formatted"].encode()
        assert [chat.unescape(data[s : s + n].decode()) for s, n in zip(r["loss_start"], r["loss_length"])] == [x[3] for x in own if x[2] == "assistant"]
        assert r["formatted"].count("<|im_start|>") == r["n_turns"] == len(own)
        assert not any(c in r["formatted"] for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_digests_of_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(df)).count() == 0


def cosines(x):
    y = vectors.unit(np.array(x, float))
    return y @ y.T


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    near = base[:20] + rng.normal(size=(20, 8)) * 0.08
    good = [*base, *near, base[0], base[0] * 1e150, base[1] * 1e-150]
    odd = [None, [0.0] * 8, [1.0, None] * 4, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, []]
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], i % 3, "x", 5) for i, v in enumerate([*good, *odd])]
    rows += [rows[0], (None, [float(c) for c in base[2]], None, None, None), (500, [1.0, 2.0], 0, "x", 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, v int").repartition(3)
    usable = [*good, base[0], base[2]]
    ids = [*range(len(good)), 0, None]
    link = cosines(usable) >= 0.9
    got = Counter((r["vec_id"], r["n_links"]) for r in vectors.near_vectors(df, shard_rows=15).collect())
    want = Counter([(ids[i], int(link[i].sum()) - 1) for i in range(len(ids))] + [(i, 0) for i in range(len(good), len(good) + len(odd))] + [(500, 0)])
    assert got == want
    found, there = vectors.audit(df, shard_rows=15)
    assert there and found >= 0.9 * there


def test_groups_larger_than_the_lists_of_neighbours(spark):
    """Only groups of 100 noisy copies in one shard: the graph has a part for each, and all links are within them."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(10, 32)), 100, axis=0) + rng.normal(size=(1000, 32)) * 0.1
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    link = cosines(x) >= 0.9
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * (link.sum() - len(x))
    assert all(r["component_id"] == i // 100 * 100 for i, r in got.items())


def test_every_node_can_be_reached():
    graph = np.array([[1, -1], [0, -1], [3, -1], [4, 2], [2, -1], [6, -1], [0, -1]])
    starts = vectors.entries(graph, 0)
    seen = np.zeros(len(graph), bool)
    vectors.reached(graph, seen, starts)
    assert seen.all() and len(starts) == 3


def test_near_vectors_of_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(df).count() == 0


def test_large_shards_are_split(spark):
    """One tight cloud that the first centroids cannot know: samples of 40 rows, shards of 30, two levels of splits; recall by audit."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.repeat(rng.normal(size=(300, 24)), 3, axis=0) + rng.normal(size=(900, 24)) * 0.1, rng.normal(size=24) + rng.normal(size=(600, 24)) * 0.5])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, there = vectors.audit(df, shard_rows=100, sample_rows=60)
    assert there and found >= 0.9 * there


def test_ties_and_lengths(spark):
    """Vectors of 70 lengths, each twice and once turned by little: all lengths are compared."""
    rows = [(10 * d + k, [1.0] * d + [0.0, 0.001 * (k == 2)]) for d in range(1, 71) for k in range(3)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (2, i // 10 * 10) for i, _ in rows}


def test_families_are_counted_without_their_pairs(spark):
    """A family of 400 near copies in several overlapping shards: exact links, but what the shards give is a few rows a node."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=16) + rng.normal(size=(400, 16)) * 0.15, rng.normal(size=(400, 16))])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    staged = Staged(spark, "vectors")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df, shard_rows=200, staged=staged).collect()}
    want = (cosines(x) >= 0.9).sum(axis=1) - 1
    assert abs(sum(got.values()) - want.sum()) <= 0.02 * want.sum() and all(got[i] <= want[i] for i in got)
    assert spark.read.parquet(f"{staged.root}/found").count() <= 16 * len(x) < want.sum() // 2


def test_a_query_gets_one_region_of_a_family():
    """A family of 500 is one find of each query, however many of its members the beam meets."""
    rng = np.random.default_rng(3)
    x = vectors.unit(np.concatenate([rng.normal(size=8) + rng.normal(size=(500, 8)) * 0.02, rng.normal(size=(20, 8))]))
    graph = vectors.neighbours(x, 40)
    region = vectors.regions(len(x), np.repeat(np.arange(500), 40), graph[:500].ravel())
    q, hit = vectors.beam_search(x, graph, np.array([0]), x, 0.9, region, np.arange(len(x)))
    assert len(q) < 3 * len(x) and set(hit[q < 500].tolist()) >= {0}
