"""Each stage against a plain computation on its own input."""

import os
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from streamloom.llm import language, minhash
from streamloom.llm.common import Staged

from test_documents import documents, expected_bytes, linked_groups


def multiset(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_stages(messy, spark, tokenizer):
    from tokenizers import Tokenizer

    staged, given = Staged(spark, "test"), {}
    docs = messy
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        docs = staged.write(stage(spark, docs, ""), name)
        if name != "packing":
            assert docs.columns == messy.columns
    given["end"] = docs

    # language: what the detector does not reject, one text at a time
    detector = language.fit(messy)
    kept = Counter(d for d, t in [(r["doc_id"], r["text"]) for r in messy.collect()] if not detector.judge([t])[3][0])
    assert Counter(r["doc_id"] for r in given["near_dedup"].collect()) == kept
    # near copies: one row of each group of brute force
    rows = documents(given["near_dedup"])
    group = dict(zip(rows, linked_groups(rows)))
    left = [group[d] for d in documents(given["suffix_array_dedup"])]
    assert Counter(left) == Counter(set(group.values()))
    # repeated bytes
    want = Counter((d, kept.decode(errors="ignore")) for d, _, _, _, kept in expected_bytes(documents(given["suffix_array_dedup"])))
    assert Counter((str(r["doc_id"]), r["text"]) for r in given["mixing"].collect()) == Counter({k: n for k, n in want.items() if k[1].strip()})
    assert all(r["n_chars"] == len(r["text"]) for r in given["mixing"].collect())
    # the mixture holds every document, and nothing else
    assert multiset(given["packing"], *messy.columns).keys() == multiset(given["mixing"], *messy.columns).keys()
    # the pieces hold the ids of every text, each once
    encode = Tokenizer.from_file(tokenizer).encode
    tokens = Counter((r["doc_id"], len(encode(r["text"], add_special_tokens=False).ids) + 1) for r in given["packing"].collect())
    total = Counter()
    for r in given["end"].collect():
        total[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert total == Counter({k: n * k[1] for k, n in tokens.items()})


def test_empty_table(empty, spark):
    staged, docs = Staged(spark, "test"), empty
    for name, stage in corpus_pipeline.STAGES:
        docs = staged.write(stage(spark, docs, ""), f"empty-{name}")
        assert docs.count() == 0


def test_clashing_names(spark):
    """Columns that bear the names of the operators' own ones come through."""
    names = ["rejected", "lang_pred", "score", "__id", "__h1", "slot", "offset", "epoch", "block", "kept", "runs", "id", "c", "s", "bucket", "size"]
    text = "a clean text about stones and rivers under the green clouds "
    rows = [(i, text * 3 + str(i), "xx", f"s{i % 2}", 5, *[f"{n}-{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    staged, now = Staged(spark, "test"), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = staged.write(stage(spark, now, ""), f"clash-{name}")
        assert now.columns == docs.columns
        assert all(r[n] == f"{n}-{r['doc_id']}" for r in now.collect() for n in names)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    by = {}
    for r in out.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and sum(n for _, n in parts) <= 4096


def test_few_files(messy, spark, monkeypatch):
    """The tables of the dedup stages are whole and have few files, however many partitions were dealt out."""
    found, write = {}, Staged.write

    def watched(self, df, name):
        out = write(self, df, name)
        found[self.root, name] = len(out.inputFiles())
        return out

    most = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    assert Staged(spark, "test", few=spark.range(10**9)).files == 8 * 10**9 // (128 << 20)  # large inputs: by their bytes
    staged = Staged(spark, "test", few=spark.range(1000))
    out = staged.write(spark.range(1000).repartition(50).withColumn("n", F.monotonically_increasing_id()), "many")
    assert len(out.inputFiles()) == most and {r["id"] for r in out.collect()} == set(range(1000)) and out.select("n").distinct().count() == 1000
    docs = Staged(spark, "test").write(messy.repartition(3 * most), "docs")
    monkeypatch.setattr(Staged, "write", watched)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # a partition for each file
    try:
        assert docs.rdd.getNumPartitions() > most
        near = corpus_pipeline.near_dedup(spark, docs, "")
        suffix = corpus_pipeline.suffix_array_dedup(spark, docs, "")
        assert near.count() and suffix.count() and found and max(found.values()) <= most
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_staged_tables_have_no_checksum_files(spark):
    """Each file beside a table is one more start of chmod in an executor; a table that is a part has half as many files."""
    staged = Staged(spark, "test", few=spark.range(1000))
    for part in (False, True):
        out = (staged.write_part if part else staged.write)(spark.range(1000).repartition(50), f"part-{part}")
        assert sorted(r["id"] for r in out.collect()) == list(range(1000)) and len(out.inputFiles()) == (-(-staged.files // 2) if part else staged.files)
        at = (staged.root + f"/part-{part}").removeprefix("file://").removeprefix("file:")
        assert os.path.isdir(at) and not [x for x in os.listdir(at) if x.endswith(".crc")]


def test_similarity_by_counting():
    """The module's own similarity beside one written out here."""
    words = lambda t: t.split()
    bag = lambda t: Counter(tuple(words(t)[i : i + 5]) for i in range(max(len(words(t)) - 4, 1)))
    rng = np.random.default_rng(7)
    for _ in range(50):
        a, b = (" ".join("ab"[x] for x in rng.integers(0, 2, rng.integers(1, 30))) for _ in range(2))
        x, y = bag(a), bag(b)
        assert np.isclose(minhash.overlap(minhash.elements(a), minhash.elements(b)), sum((x & y).values()) / sum((x | y).values()))


def test_entry_names_them():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
