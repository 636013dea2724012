"""Suffix-array dedup of bytes: a byte goes if a string of `LENGTH` bytes that covers it also starts earlier.

The difference-cover algorithm sorts the suffixes at sampled places and merges those at all others, so it moves a row for each
byte. Here the sample is a synchronising set in place of the cover modulo 3 (README: figures): places are chosen by content, about
one of 40, and of any two equal strings the same place is in the set, which is what the cover is for. Nothing
else of that algorithm is left out or renamed: there is no order of all suffixes and there are no ranks. What decides is
windows.py: sampled places that share the bytes around them are grouped, and those bytes grow in steps of three until they are
the whole string of LENGTH bytes or nobody else has them.

Defined cases: null text is empty; null doc_id is smaller than all others; rows that share a doc_id are one document where
strings are judged by place; texts of any length are cut into parts that overlap; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import Staged, slices, table
from streamloom.llm.windows import Kind, covered_tokens, keyed, repeated_windows, text_bytes, with_repeats

LENGTH, SAMPLE = 100, 20


def suffix_dedup(docs: DataFrame, keep: tuple[str, ...] = (), decode: bool = False, few: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs: start, length), kept (the bytes that stay; with decode the
    characters that stay whole), and the columns of keep. few: see Staged."""
    staged = Staged(docs.sparkSession, "suffixes", docs if few else None)
    rows = keyed(docs, keep)
    repeats = repeated_windows(rows.select("id", "text"), Kind("bytes", LENGTH, SAMPLE), True, staged)

    def run(batches):
        for b in slices(batches):
            total, removed, spans, kept = [], [], [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                data = text_bytes(text)
                gone = covered_tokens(len(data), runs, LENGTH)
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                total.append(len(data))
                removed.append(int(gone.sum()))
                spans.append([{"start": s, "length": e - s} for s, e in zip(start.tolist(), end.tolist())])
                rest = data[~gone].tobytes()
                kept.append(rest.decode(errors="ignore") if decode else rest)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string() if decode else pa.binary()), *(b.column(f"__keep_{c}") for c in keep)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", *keep])

    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,length:bigint>>, kept " + ("string" if decode else "binary")
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return with_repeats(rows, repeats).select("doc_id", "text", "runs", *[f"__keep_{c}" for c in keep]).mapInArrow(run, schema)


def op6_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(h[2 * i - 1:2 * i + 198]) AS k FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 98)) AS i FROM d)),
f AS (SELECT k, min((doc_id, i)) AS first FROM w GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE (doc_id, i) > first),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM hit),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM r GROUP BY 1, 2),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS p, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(h[2 * p - 1:2 * a - 2] || CASE WHEN last THEN h[2 * b - 1:] ELSE '' END, '' ORDER BY a) AS k FROM cuts JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
