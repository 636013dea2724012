r"""Exact substring dedup of words by seed and extend.

Seeds are winnowed anchors of `SEED` words; documents meet where they share one. A match is extended both ways from the
anchor, step by step (windows.py): whoever shares the seed is compared by the whole run of windows around it, and where runs
differ, by longer and longer strings around the seed, up to WINDOW words. What still meets then is a match;
neighbouring matches are joined, so a document's spans are its maximal repeats of at least WINDOW words, and they go
from all documents but the one of the smallest doc_id in which their windows start.

Words are runs of other than \x20 and \x09-\x0D and are left as they are.

Defined cases: null text has no words; null doc_id is smaller than all others; rows that share a doc_id are one document
where windows are judged (none of them removes words of another); texts of any length are cut into parts that overlap by
a window; an empty table gives an empty table; other columns pass through where `keep` names them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import Staged, slices, table
from streamloom.llm.windows import Kind, covered_tokens, keyed, repeated_windows, text_bytes, with_repeats, word_spans

WINDOW, SEED = 13, 4


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space), spans (removed runs of words: start, length)."""
    staged = Staged(docs.sparkSession, "substrings", docs)
    kind = Kind("words", WINDOW, SEED)
    rows = keyed(docs)
    repeats = repeated_windows(rows.select("id", "text"), kind, False, staged)

    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches):
        for b in slices(batches):
            total, removed, kept, spans = [], [], [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                start, end = word_spans(text_bytes(text))
                gone = covered_tokens(len(start), runs, WINDOW)
                data = text.encode()
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                first, after = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
                spans.append([{"start": i, "length": j - i} for i, j in zip(first, after)])
                total.append(len(start))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(data[s:e] for s, e in zip(start[~gone].tolist(), end[~gone].tolist())).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kinds)], names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    return with_repeats(rows, repeats).select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:bigint,length:bigint>>")


def op2_substring_dedup(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (k) WHERE doc_id > first),
g AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY 1),
kept AS (SELECT d.doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) d ANTI JOIN gone ON gone.doc_id = d.doc_id AND gone.p = d.p GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
