"""Quality rules by cross-document line frequency, in DataFrame operations only.

A document is cut at "\\n" into lines. A line counts if it holds a word; it is normalised (lower case, runs of
white space to one space, trimmed) and hashed. For each host (the `source` column; null is a host of its own) the
distinct documents that hold the hash are counted. A line is boilerplate if more documents of its host hold it than
max(min_docs, share * documents of the host). Boilerplate lines are removed, and a document is depleted if more than
`max_removed` of its words stood in them.

Defined cases: null text is a document without words (it fails the base rules); an empty table gives an empty table;
rows that repeat (doc_id, text) are judged alike and count once for each row of the host; null doc_id is kept as an
id like others; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import SPACES, WORD_SPLIT, text_or_empty

SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body names it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more; words is a lambda variable or a plain column."""
    n = F.size(words)
    grams = F.when(
        n >= 3,
        F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(sorted_pairs: Column) -> Column:
        g = lambda j: F.get(sorted_pairs, j)["g"]
        hit = F.filter(sorted_pairs, lambda p, j: F.coalesce(g(F.greatest(j - 1, F.lit(0))) == p["g"], F.lit(False)) & (j > 0) | F.coalesce(g(j + 1) == p["g"], F.lit(False)))
        at = F.sort_array(F.transform(hit, lambda p: p["i"]))
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    pairs = lambda g: F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(pairs(g), covered)))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text hash and the base figures of each document."""
    text = text_or_empty()
    bare = lambda chars: F.translate(text, chars, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    figures = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("r")))
    out = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("host"),
        F.xxhash64(text).alias("text_hash"),
        F.length(bare(SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(bare(SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        figures.alias("figures"),
    )
    n, r = F.col("figures.n"), F.col("figures.r")
    return out.select(
        "doc_id", "host", "text_hash", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), ((n < 50) | (100 * r > 50 * n)).alias("base_failed")
    )


def document_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, host and each line that holds a word: position, hash, number of words."""
    text = text_or_empty()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col("source").cast("string").alias("host"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.where(F.translate("line", SPACES, "") != "")
    normal = F.lower(F.trim(F.regexp_replace("line", WORD_SPLIT, " ")))
    return rows.select("doc_id", "text_hash", "host", "pos", F.xxhash64(normal).alias("line_hash"), (F.length(normal) - F.length(F.translate(normal, " ", "")) + 1).cast("long").alias("line_words"))


def boilerplate_lines(docs: DataFrame, min_docs: int, share: float) -> DataFrame:
    """host, line_hash of the lines above the limit of their host."""
    text = text_or_empty()
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != ""), lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, WORD_SPLIT, " "))))))
    held = docs.select(F.col("source").cast("string").alias("host"), F.explode(lines).alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("docs_with"))
    limits = docs.groupBy(F.col("source").cast("string").alias("h")).agg(F.greatest(F.lit(float(min_docs)), F.count("*") * share).alias("limit"))
    return held.where(F.col("docs_with") > min_docs).join(limits, F.col("host").eqNullSafe(F.col("h"))).where(F.col("docs_with") > F.col("limit")).select("host", "line_hash")


def quality_rules(docs: DataFrame, min_docs: int = 20, share: float = 0.002, max_removed: float = 0.5, clean_text: bool = False) -> DataFrame:
    """One row per document: base figures, n_boilerplate_lines, removed_words, depleted, kept; with clean_text also
    the text without its boilerplate lines."""
    bad = boilerplate_lines(docs, min_docs, share).select(F.col("host").alias("bad_host"), F.col("line_hash").alias("bad_hash"))
    hits = document_lines(docs).join(bad, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("line_hash") == F.col("bad_hash")))
    # a set: rows that repeat a document give each line once
    per_doc = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("host").alias("h")).agg(F.collect_set(F.struct("pos", "line_words")).alias("hit"))
    removed = F.aggregate("hit", F.lit(0).cast("long"), lambda a, x: a + x["line_words"])
    per_doc = per_doc.select("d", "t", "h", F.size("hit").cast("long").alias("n_boilerplate_lines"), removed.alias("removed_words"), F.transform("hit", lambda x: x["pos"]).alias("hit_pos"))
    base = base_rules(docs)
    if clean_text:
        texts = docs.select(F.col("doc_id").alias("d0"), F.xxhash64(text_or_empty()).alias("t0"), text_or_empty().alias("text")).dropDuplicates(["d0", "t0"])
        base = base.join(texts, F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("text_hash") == F.col("t0"))).drop("d0", "t0")
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & F.col("host").eqNullSafe(F.col("h"))
    out = base.join(per_doc, on, "left")
    removed, n = F.coalesce("removed_words", F.lit(0)), F.col("n_words")
    depleted = removed > n * max_removed
    out = out.select(
        *[c for c in base.columns if c not in ("text_hash", "text")],
        F.coalesce("n_boilerplate_lines", F.lit(0)).cast("long").alias("n_boilerplate_lines"), removed.cast("long").alias("removed_words"), depleted.alias("depleted"), (~F.col("base_failed") & ~depleted).alias("kept"),
        *([F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("hit_pos", i), F.lit(False))), "\n").alias("clean_text")] if clean_text else []),
    )
    return out


def op8_quality_rules(spark, sf_dir):
    from streamloom.llm.common import table

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.drop("host")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + o AS p FROM rep, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY 1),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, source, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY 1),
host AS (SELECT source, greatest(20, count(*) * 0.002) AS lim FROM d GROUP BY 1),
bad AS (SELECT f.source, f.norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS c FROM lw GROUP BY 1, 2) f JOIN host h ON h.source IS NOT DISTINCT FROM f.source WHERE f.c > h.lim),
rm AS (SELECT lw.doc_id, count(*) AS nl, sum(len(regexp_extract_all(lw.norm, '[^ ]+'))) AS nw FROM lw JOIN bad ON bad.source IS NOT DISTINCT FROM lw.source AND bad.norm = lw.norm GROUP BY 1),
j AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  coalesce(rm.nl, 0)::BIGINT AS n_boilerplate_lines, coalesce(rm.nw, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rm USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  n_boilerplate_lines, removed_words, removed_words > n_words * 0.5 AS depleted,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (removed_words > n_words * 0.5) AS kept FROM j
"""
