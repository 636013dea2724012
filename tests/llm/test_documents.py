"""Operators on documents against brute force, over a table that holds every odd case."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from streamloom.llm import language, minhash, mixing, packing, quality, shards, substrings, suffixes, windows
from streamloom.llm.common import Staged

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def documents(messy):
    return [(r["doc_id"], r["text"] or "") for r in messy.select("doc_id", "text").collect()]


def order(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


# -- substring dedup --


def expected_words(docs):
    first = {}
    for d, t in docs:
        w = WORDS.findall(t)
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, 1 << 62), order(d))
    out = []
    for d, t in docs:
        w = WORDS.findall(t)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < order(d):
                gone[p : p + 13] = [True] * 13
        out.append((str(d), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def test_substring_dedup(messy):
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in rows_of(substrings.substring_dedup(messy)))
    # two documents without an id share one: they do not remove words of each other
    assert got == expected_words(documents(messy))


def test_substring_dedup_writes_few_files(messy, spark, monkeypatch):
    """No staged table has a file for each partition of the input; the rows are those of the plain computation."""
    found, write = {}, Staged.write

    def watched(self, df, name):
        out = write(self, df, name)
        found[self.root, name] = len(out.inputFiles())
        return out

    most = 2 * spark.sparkContext.defaultParallelism
    docs = Staged(spark, "test").write(messy.repartition(3 * most), "docs")
    monkeypatch.setattr(Staged, "write", watched)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # a partition for each file
    try:
        assert docs.rdd.getNumPartitions() > most
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in rows_of(substrings.substring_dedup(docs)))
        assert got == expected_words(documents(messy)) and found and max(found.values()) <= most
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# -- suffix-array dedup --


def expected_bytes(docs):
    first = {}
    for d, t in docs:
        b = t.encode()
        for p in range(len(b) - 99):
            k = b[p : p + 100]
            first[k] = min(first.get(k, (1 << 62, 0)), (order(d), p))
    out = []
    for d, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (order(d), p):
                gone[p : p + 100] = True
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        out.append((str(d), len(b), int(gone.sum()), int((edges == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out)


def test_suffix_dedup(messy):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rows_of(suffixes.suffix_dedup(messy)))
    assert got == expected_bytes(documents(messy))


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK_TOKENS", 150)
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 101, 900)))
    docs = spark.createDataFrame([(1, text), (2, text[300:] + "zz"), (3, text[:100])], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rows_of(suffixes.suffix_dedup(docs)))
    assert got == expected_bytes(documents(docs))


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(0)
    same = rng.integers(0, 4, 60, np.uint8)
    kind = windows.Kind("bytes", 20, 4)
    seen = set()
    for _ in range(20):
        around = [rng.integers(0, 4, rng.integers(20, 40), np.uint8) for _ in range(2)]
        raw = np.concatenate([around[0], same, around[1]])
        x = windows.anchors(kind.values(raw), np.array([len(raw)]), 20, 4)
        at = len(around[0])
        seen.add(tuple(int(x["ah"][np.searchsorted(x["lo"], at + p, "right") - 1]) for p in range(41)))
    assert len(seen) == 1


# -- near-dedup --


def linked_groups(docs):
    """A number for each document's group."""
    sets = [minhash.elements(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if minhash.overlap(sets[i], sets[j]) >= 0.8:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(docs))]


def expected_groups(docs):
    least, tops = {}, linked_groups(docs)
    for t, (d, _) in zip(tops, docs):
        least[t] = min(least.get(t, 1 << 62), order(d))
    return Counter((order(d), least[t]) for t, (d, _) in zip(tops, docs))


def test_near_duplicates(messy):
    got = rows_of(minhash.near_duplicates(messy))
    assert Counter((r["id"], r["component_id"]) for r in got) == expected_groups(documents(messy))
    with_words = {r["component_id"] for r in got}
    assert sum(r["kept"] for r in got) >= len(with_words)
    kept = minhash.without_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert Counter(r["doc_id"] for r in kept.collect())[0] == 1


@pytest.mark.parametrize("small", [32, 1])
def test_links_between_others_than_the_centre(spark, small):
    """Families of edits and of cut copies, in one bucket: no link may be lost, whichever document is its centre."""
    rng = np.random.default_rng(4)
    word = lambda: "w" + str(rng.integers(1 << 30))
    base = [word() for _ in range(100)]
    rows = [" ".join(base), " ".join(base[:90]), " ".join(base[:76]), " ".join(base[:60]), " ".join(base[30:])]
    for family in range(2):
        own = list(base)
        own[10 * family : 10 * family + 14] = [word() for _ in range(16)]
        for _ in range(4):
            one = list(own)
            one[rng.integers(len(one))] = word()
            rows.append(" ".join(one))
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    labels = minhash.link(spark.createDataFrame([(1, i) for i in range(len(rows))], "g long, node long"), docs, Staged(spark, "test"), small)
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert Counter((i, got.get(i, i)) for i in range(len(rows))) == expected_groups(list(enumerate(rows)))
    assert len(set(got.values())) > 1


def test_links_within_a_family_of_templates(spark):
    """Documents of ten of twenty common sentences, far below the threshold, are one bucket with one planted pair."""
    rng = np.random.default_rng(7)
    word = lambda: "w" + str(rng.integers(1 << 30))
    sentences = [[word() for _ in range(12)] for _ in range(20)]
    rows = [[w for k in sorted(rng.choice(20, 10, replace=False)) for w in sentences[k]] for _ in range(300)]
    rows.append([*rows[290][:50], word(), *rows[290][51:]])
    rows = list(enumerate(map(" ".join, rows)))
    members = spark.createDataFrame([(1, i) for i, _ in rows], "g long, node long")
    labels = minhash.link(members, spark.createDataFrame(rows, "id long, text string"), Staged(spark, "test"))
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert got[300] == got[290]
    assert Counter((i, got.get(i, i)) for i, _ in rows) == expected_groups(rows)


def test_components_stop_at_stars(spark, monkeypatch):
    """Links that are stars already cost no round; others are those of a plain search, and no round confirms the last."""
    found, write = [], Staged.write

    def watched(self, df, name):
        found.append(name)
        return write(self, df, name)

    monkeypatch.setattr(Staged, "write", watched)
    star, path = [(9, 2), (5, 2), (4, 2), (8, 3), (3, 8)], [(i + 1, i) for i in range(20)]
    for links, most in ((star, 1), (path, 7), (star + [(9, 8)], 3), ([(7, 7)], 1)):
        found.clear()
        got = {r["node"]: r["label"] for r in minhash.components(spark.createDataFrame(links, "a long, b long"), Staged(spark, "test")).collect()}
        want = {n: n for link in links if link[0] != link[1] for n in link}
        for _ in want:
            for a, b in links:
                if a != b:
                    want[a] = want[b] = min(want[a], want[b])
        assert got == want and len(found) <= most, found


def test_minhash_writes_few_files(spark, tmp_path, monkeypatch):
    """However many partitions a shuffle has, op10's tables have few files; the groups are those of brute force."""
    found, write = [], Staged.write

    def watched(self, df, name):
        out = write(self, df, name)
        found.append(len(out.inputFiles()))
        return out

    text = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(text if i % 3 else [*text[:50], f"x{i}", *text[51:]] if i % 2 else [f"y{i}-{j}" for j in range(9)])) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    monkeypatch.setattr(Staged, "write", watched)
    most = 2 * spark.sparkContext.defaultParallelism
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 2 * most)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = Counter((r["doc_id"], r["component_id"]) for r in minhash.op10_minhash(spark, str(tmp_path)).collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == expected_groups(rows) and found and max(found) <= most


@pytest.mark.parametrize("block", [256, 7])
def test_prefix_join_finds_what_brute_force_does(spark, block):
    """Truncations, edits and templates with common parts, in blocks that are dealt out: the same groups."""
    rng = np.random.default_rng(8)
    word = lambda: "w" + str(rng.integers(1 << 30))
    text = [word() for _ in range(400)]
    rows = [" ".join(text[:n]) for n in (20, 40, 49, 100, 180, 220, 300, 370, 400)]
    for i in range(90):
        own = text[200 : 200 + 60 + i % 5]
        for at in rng.integers(len(own), size=i % 4):
            own[at] = word()
        rows.append(" ".join(own))
    rows += [" ".join(text[:70] + [word() for _ in range(20)]) for _ in range(30)]
    want = expected_groups(list(enumerate(rows)))
    known = [(i, k) for i, k in want if i % 3]  # groups that are known in part
    left = spark.createDataFrame(known + [(i, i) for i in range(0, len(rows), 3)], "node long, label long")
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    staged = Staged(spark, "test")
    links = minhash.joined_by_prefix(left, docs, staged, block).unionByName(spark.createDataFrame(known, "a long, b long"))
    got = {r["node"]: r["label"] for r in minhash.components(links, staged).collect()}
    assert Counter((i, got.get(i, i)) for i in range(len(rows))) == want


def test_signatures_estimate_weighted_jaccard():
    a, b = np.arange(1, 300, dtype=np.uint64), np.arange(100, 400, dtype=np.uint64)
    rng = np.random.default_rng(2)
    wa, wb = rng.integers(1, 9, len(a)), rng.integers(1, 9, len(b))
    sig = minhash.bag_min_hash(minhash.mixed(np.concatenate([a, b])), np.concatenate([wa, wb]), np.repeat([0, 1], [len(a), len(b)]), 2, 8192)
    weight = {x: [0, 0] for x in range(400)}
    for i, (x, w) in enumerate(((a, wa), (b, wb))):
        for k, v in zip(x.tolist(), w.tolist()):
            weight[k][i] = v
    true = sum(min(v) for v in weight.values()) / sum(max(v) for v in weight.values())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.02


# -- packing --


def test_pack(messy, tokenizer):
    got = rows_of(packing.pack(messy, tokenizer))
    encoder = packing.Encoder(tokenizer)
    want = Counter()
    ids = {}
    for d, t in documents(messy):
        x = np.append(encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2).astype("<u4")
        ids.setdefault((d, len(x)), []).append(x)
        want[d, len(x)] += len(x)
    have = Counter()
    for r in got:
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"], r["doc_tokens"]])
    assert have == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.03 * sum(want.values())


def test_words_have_the_tokenizers_ids(tokenizer):
    encoder = packing.Encoder(tokenizer)
    for text in ["It's <|endoftext|> don't 'S 12ab \x0b\x1c q", "", "  ", "éÉ ΑΣ Σ é ́x ﬁ", "a b c", "İstanbul ǅ", "ÀÉÿ ß ×÷ µª naïve-Ñandú ça!"]:
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["aAbsStTdDlLmrRevVéÉßÀþ'\"',.!<>09 \n\t\r", "aS'lé ÉŸ,.<|>0\n µ÷×ªº\x0b\x0c\x00\x1cςΣİﬁ中"])
def test_whole_texts_have_the_tokenizers_ids(tokenizer, letters):
    rng, encoder = np.random.default_rng(5), packing.Encoder(tokenizer)
    for n in rng.integers(0, 30, 4000):
        text = "".join(rng.choice(list(letters), n))
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_column_generation_covers_the_demand():
    rng = np.random.default_rng(3)
    demand = rng.integers(0, 50, 32)
    patterns, x = packing.column_generation(demand)
    assert (patterns.T @ x >= demand - 1e-6).all()
    assert all((p * np.arange(1, 33)).sum() <= 32 for p in patterns)
    bound = (demand * np.arange(1, 33)).sum() / 32
    assert x.sum() <= 1.05 * bound + 1
    intervals, _ = packing.plan(demand)
    placed = Counter()
    for k, _, _, per, times in intervals:
        placed[k] += per * times
    assert placed == Counter({i + 1: int(n) for i, n in enumerate(demand) if n})


# -- language --


def test_language(messy, spark):
    detector = language.fit(messy)
    got = rows_of(language.identify(messy, detector, keep=("doc_id", "text")))
    assert len(got) == messy.count()
    for r in got:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has_letter)
        assert 0 <= r["score"] <= 1


def test_language_accuracy_on_what_was_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.identify(docs, language.fit(docs), keep=("doc_id", "lang")).withColumn("held_out", language.held_out())
    held = [r for r in got.collect() if r["held_out"]]
    assert held and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_probabilities_sum_to_one():
    models = language.Models({"a": ["abra cadabra abra"], "b": ["banana band"]})
    letters = [chr(int(x)) for x in {ord(c) for c in " abrcdn"}]
    for context in ["abr", "   ", "xyz", "ban"]:
        total = sum(np.exp(models.place_logs(np.array([ord(c) for c in context + x], np.uint32))[0]) for x in letters) + np.exp(models.place_logs(np.array([ord(c) for c in context + "一"], np.uint32))[0])
        assert np.allclose(total, 1, atol=1e-4)


def test_no_labels(empty, spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identify(docs, language.fit(docs)).first()["lang_pred"] == "und"


# -- quality rules --


def expected_base(text):
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + o for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(messy):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows_of(quality.quality_rules(messy)))
    assert got == Counter((d, *expected_base(t)) for d, t in documents(messy))


def test_boilerplate_goes(spark):
    rows = [(i, "s", f"unique line number {i} " * 5 + "\nBuy  NOW " + str(i % 2)) for i in range(12)] + [(99, "s", "Buy now 0\nbuy now 1\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in rows_of(quality.quality_rules(docs, min_docs=4, share=0.0, clean_text=True))}
    assert got[0]["clean_text"] == "unique line number 0 " * 5 and got[0]["n_boilerplate_lines"] == 1 and not got[0]["depleted"]
    assert got[99]["clean_text"] == "x" and got[99]["depleted"] and not got[99]["kept"]


# -- sharding --


def test_shards(messy):
    got = rows_of(shards.shard(messy, n_shards=7))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in documents(messy))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    largest = max(r["size"] for r in got)
    mean = sum(r["size"] for r in got) / 7
    assert all(abs(sum(r["size"] for r in by.get(s, [])) - mean) <= largest for s in range(7))
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_overfull_ranges_are_cut(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'the same text' as text")
    got = rows_of(shards.shard(docs, n_shards=10))
    assert set(Counter(r["shard"] for r in got).values()) == {300}


# -- mixing --


def test_mix(messy):
    weights = {None: 1.0, "s1": 2.0, "s2": 1.0}
    got = rows_of(mixing.mix(messy, weights, block_bytes=500, period=64))
    assert {r["doc_id"] for r in got} == {d for d, _ in documents(messy)}
    first = Counter(r["doc_id"] for r in got if r["epoch"] == 0)
    assert first == Counter(d for d, _ in documents(messy))
    slots = {}
    for r in got:
        assert slots.setdefault(r["slot"], r["source"]) == r["source"]


def test_pfair_stays_within_a_block():
    counts = [13, 1, 20, 30]
    seen = [0] * 4
    for t, (i, j) in enumerate(mixing.pfair(counts), 1):
        assert j == seen[i]
        seen[i] += 1
        assert all(abs(seen[k] - t * c / 64) < 1 for k, c in enumerate(counts))
    assert seen == counts


# -- empty tables --


def test_empty_tables(empty, tokenizer):
    assert substrings.substring_dedup(empty).count() == 0
    assert suffixes.suffix_dedup(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert packing.pack(empty, tokenizer).count() == 0
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert quality.quality_rules(empty).count() == 0
    assert shards.shard(empty).count() == 0
    assert mixing.mix(empty).count() == 0


# -- many surroundings of one passage --


def test_one_passage_in_many_surroundings(spark):
    """One seed with more contexts than anything gathers in a task: each is told apart, in both engines."""
    rng = np.random.default_rng(8)
    passage = " ".join("p" + str(rng.integers(1000)) for _ in range(30))
    rows = []
    for i in range(600):
        before, after = (" ".join("w" + str(rng.integers(6)) for _ in range(12)) for _ in range(2))
        rows.append((i, f"{before} {passage[rng.integers(4) :]} {after}"))
    rows += [(600, rows[0][1]), (601, rows[3][1][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in rows_of(substrings.substring_dedup(docs)))
    assert got == expected_words(rows)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rows_of(suffixes.suffix_dedup(docs)))
    assert got == expected_bytes(rows)


def test_repeats_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = documents(docs)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in rows_of(substrings.substring_dedup(docs))) == expected_words(rows)
    got = rows_of(suffixes.suffix_dedup(docs))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == expected_bytes(rows)


# -- further cases --


def test_short_texts_fill_their_sequences(spark, tokenizer):
    rng = np.random.default_rng(1)
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('word ', cast(id as string), ' of a short text') as text")
    got = rows_of(packing.pack(docs, tokenizer))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    used = 0
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and sum(n for _, n in parts) <= 4096
        n = sum(n for _, n in parts)
        used += n if n & (n - 1) == 0 else 4096
    assert len({r["doc_id"] for r in got}) == 6000 and used <= 1.04 * sum(r["length"] for r in got)


def test_very_long_words_have_the_ids_of_encode(spark, tokenizer):
    from tokenizers import Tokenizer

    text = "x" * 5000 + " " + "né" * 3000 + " plain"
    encoder = packing.Encoder(tokenizer)
    assert encoder.encode(text).tolist() == Tokenizer.from_file(tokenizer).encode(text, add_special_tokens=False).ids
    assert not any(len(k) > packing.LONGEST for k in encoder.words)


def test_inverted():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 40))
    assert np.allclose(packing.inverted(m) @ m, np.eye(40))


def test_signs_that_are_no_letters():
    detector = language.Detector({"a": ["abra cadabra abra"] * 3, "b": ["banana band"] * 3})
    lang, score, _, rejected = detector.judge(["² ½", "Ⅷ", "١٢", "a²", None, ""])
    assert lang == ["und"] * 3 + [lang[3]] + ["und"] * 2 and lang[3] != "und" and rejected[:3].all()


def test_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    detector = language.fit(docs)
    finnish = "Metsän reunassa asui vanha mies joka keitti kahvia aamulla ja katseli järvelle missä sumu nousi hitaasti veden yltä kohti taivasta ja linnut lauloivat"
    polish = "Wczoraj wieczorem poszliśmy do miasta żeby zobaczyć stary zamek nad rzeką i kupić świeży chleb oraz trochę sera na kolację dla całej rodziny"
    _, _, _, rejected = detector.judge([finnish, polish])
    assert rejected.all()
    got = rows_of(language.identify(docs, detector, keep=("doc_id", "text")))
    assert np.mean([r["rejected"] for r in got if r["text"]]) < 0.01


def test_long_text_is_judged_in_parts(monkeypatch):
    models = language.Models({"a": ["abra cadabra abra"], "b": ["banana band"]})
    text = "abra banana " * 50
    whole = models.scores([text.strip()])[0]
    monkeypatch.setattr(language, "CHUNK_CHARS", 100)
    assert np.allclose(models.scores([text.strip()])[0], whole, rtol=1e-5)


def brute_kneser_ney(texts, order):
    """Probability of a character after a context, in the plain recursive form."""
    grams = {order: Counter(c for t in texts for c in zip(*((" " * (order - 1) + t + " ")[k:] for k in range(order))))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def p(g, letters):
        k = len(g)
        if not k:
            return 1 / (letters + 1)
        ones, twos = (sum(v == n for v in grams[k].values()) for n in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        own = {h: v for h, v in grams[k].items() if h[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p(g[1:], letters)
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(g[1:], letters)

    return p


def test_models_are_interpolated_kneser_ney():
    texts = {"a": ["abra cadabra abra", "bad cab"], "b": ["banana band", "nab"]}
    models = language.Models(texts)
    letters = len({c for v in texts.values() for t in v for c in f" {t}"})
    for i, name in enumerate(models.names):
        p = brute_kneser_ney(texts[name], language.ORDER)
        for context in ("abr", "ana", "xyz", "   "):
            for c in "abdn ":
                got = models.place_logs(np.array([ord(x) for x in context + c], np.uint32))[0, i]
                assert np.isclose(np.exp(got), p(tuple(context + c), letters), rtol=1e-4)


def test_mixture_stays_within_a_block_of_its_weights(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('x', 50) as text", "case when id % 10 < 7 then 'a' when id % 10 < 9 then 'b' else 'c' end as source")
    weights = {"a": 0.2, "b": 0.5, "c": 0.3}
    got = rows_of(mixing.mix(docs, weights, block_bytes=1000, period=100))
    per_slot = {}
    for r in got:
        assert per_slot.setdefault(r["slot"], r["source"]) == r["source"]
    assert sorted(per_slot) == list(range(len(per_slot)))
    seen = Counter()
    for t in range(len(per_slot)):
        seen[per_slot[t]] += 1
        assert all(abs(seen[s] - (t + 1) * w) < 1 for s, w in weights.items())


def test_ties_of_a_splitter(spark):
    """Keys of one hash are told apart by id and row number, as a plain comparison does."""
    rng = np.random.default_rng(3)
    keys = [tuple(int(x) for x in k) for k in np.stack([rng.integers(0, 3, 200), rng.integers(0, 2, 200), rng.integers(0, 4, 200), rng.integers(0, 50, 200)], 1)]
    cuts = sorted(set(keys[:30]))
    frame = {k: np.array([x[i] for x in keys]) for i, k in enumerate(shards.KEY)}
    assert shards.find_range(frame, cuts).tolist() == [sum(c <= k for c in cuts) for k in keys]
