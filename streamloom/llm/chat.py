r"""Chat formatting by columnar byte assembly.

The turns of a conversation become one text: "<|im_start|>" role "\n" text "<|im_end|>\n" for each turn. Control
strings inside roles and texts are escaped reversibly: where "<" or "[" is followed by n >= 0 backslashes and the
rest of a control string, one backslash is added; reading back takes one away. Roles also have "\" and line ends escaped.
The loss mask covers the texts of assistant turns.

A batch of conversations is assembled in numpy: the lengths of all segments, their cumulative offsets, and scatter
indices by which headers and contents are copied into one preallocated buffer that becomes the Arrow column.

Defined cases: rows are ordered by (turn, role, text), null turn first; null text or role is empty; equal rows are
turns of their own; null conv_id is a conversation of its own; an empty table gives an empty table; other columns are
not looked at. One conversation is one output row, so it is built by one task; its length is bounded by what one text
may hold.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import table

# fixed values: control strings of common chat templates; those of the template itself first
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
START, END = b"<|im_start|>", b"<|im_end|>\n"
LOSS_ROLE = "assistant"
RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)
ESCAPE = rf"([<\[])(\\*)({RESTS})"
UNESCAPE = re.compile(rf"([<\[])\\(\\*)({RESTS})")


def escape(texts: pa.Array) -> pa.Array:
    # "<<SYS>>" holds "<SYS>>", whose "<" may start no control string, so one pass finds every place
    return pc.replace_substring_regex(texts, pattern=ESCAPE, replacement=r"\1\\\2\3")


def escape_role(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(pc.replace_substring(roles, pattern="\\", replacement="\\\\"), pattern="\n", replacement="\\n")
    return escape(roles)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, and where each begins (with one end more)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
    """Copy string i of data to out[to[i]:]."""
    for i, j in spans(off):
        lengths = np.diff(off[i : j + 1])
        part = np.arange(off[i], off[j])
        part += np.repeat(to[i:j] - off[i:j], lengths)
        out[part] = data[off[i] : off[j]]


def spans(off: np.ndarray, most: int = 1 << 22):
    """Consecutive strings whose indices are made at once, so that these take little room beside the strings."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def assemble(roles: pa.Array, texts: pa.Array, first_turn: np.ndarray):
    """Formatted texts, and for each turn where its text begins in its conversation, and its length (bytes, escaped).

    first_turn: of each conversation, with one end more.
    """
    (r, r_off), (t, t_off) = raw(escape_role(roles)), raw(escape(texts))
    r_len, t_len = np.diff(r_off), np.diff(t_off)
    segment = len(START) + r_len + 1 + t_len + len(END)
    at = np.concatenate([[0], np.cumsum(segment)])
    out = np.empty(at[-1], np.uint8)
    head, text_at = at[:-1] + len(START), at[:-1] + len(START) + r_len + 1
    for const, to in ((START, at[:-1]), (b"\n", head + r_len), (END, text_at + t_len)):
        out[(to[:, None] + np.arange(len(const))).ravel()] = np.tile(np.frombuffer(const, np.uint8), len(to))
    scatter(out, head, r, r_off)
    scatter(out, text_at, t, t_off)
    conv_off = at[first_turn]
    made = pa.LargeStringArray.from_buffers(len(first_turn) - 1, pa.py_buffer(conv_off.astype(np.int64).tobytes()), pa.py_buffer(out))
    return made, text_at - np.repeat(conv_off[:-1], np.diff(first_turn)), t_len


def in_parts(batches, most: int = 64 << 20):
    """Batches in parts of about `most` bytes of texts (a single longer conversation is a part of its own)."""
    for b in batches:
        texts = b.column("texts")
        ends = pc.cast(pc.fill_null(pc.binary_length(texts.flatten()), 0), pa.int64()).to_numpy(zero_copy_only=False).cumsum()
        last = np.concatenate([[0], np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))])
        size = np.concatenate([[0], ends])[last]
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, size[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, n_turns, loss_start and loss_length (arrays; bytes in the UTF-8 of formatted)."""
    grouped = turns.select(F.col("conv_id").cast("long"), F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("row"))
    grouped = grouped.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    grouped = grouped.select("conv_id", F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))

    def run(batches):
        for b in in_parts(batches):
            roles, texts = b.column("roles"), b.column("texts")
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(roles).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = roles.flatten()
            made, start, length = assemble(flat, texts.flatten(), first)
            loss = pc.equal(flat, LOSS_ROLE).to_numpy(zero_copy_only=False).astype(bool)
            per = np.concatenate([[0], np.cumsum(loss)])[first].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(per), pa.array(x[loss].astype(np.int64))) for x in (start, length)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), made.cast(pa.string()), pa.array(np.diff(first)), *lists], names=["conv_id", "formatted", "n_turns", "loss_start", "loss_length"])

    return grouped.mapInArrow(run, "conv_id long, formatted string, n_turns long, loss_start array<long>, loss_length array<long>")


TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    at, out = 0, []
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digests(chats: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for cid, text, start, length in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length"))):
                turns, data = read_back(text), text.encode()
                loss = "".join(unescape(data[s : s + n].decode()) for s, n in zip(start, length))
                rows.append((cid, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_chats(turns.unionByName(extra)))


OP4_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length('<|im_start|>') + 1 + length('<|im_end|>') + 1
  + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{ESCAPE}', '\1\\\2\3', 'g'))
  + length(regexp_replace(text, '{ESCAPE}', '\1\\\2\3', 'g')) AS n FROM t),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM f GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
