"""A corpus pipeline of five stages over `documents`: language ID, near-dedup, suffix dedup, mixing, packing.

Each stage takes what its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import Staged, table
from streamloom.llm.language import fit, identify
from streamloom.llm.minhash import without_near_duplicates
from streamloom.llm.mixing import mix
from streamloom.llm.packing import pack
from streamloom.llm.suffixes import suffix_dedup


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with a copy of each column under a name of its own, so that no operator's column can clash with it; and those names."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.select("doc_id", "text", "lang", "source", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go; a missing label is filled in."""
    wide, names = set_aside(docs)
    names = {c: "text" if c == "text" else n for c, n in names.items()}  # the text is wanted once
    judged = identify(wide, fit(docs), keep=tuple(names.values())).where("NOT rejected")
    label = F.coalesce(names["lang"], "lang_pred")
    return judged.select(*[(label if c == "lang" else F.col(n)).alias(c) for c, n in names.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return without_near_duplicates(docs, few=True)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated strings go; characters that lose a byte go as a whole, and so do documents that lose everything."""
    wide, names = set_aside(docs)
    out = suffix_dedup(wide, keep=tuple(n for c, n in names.items() if c != "text"), decode=True, few=True).where(F.trim("kept") != "")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture; sources below their weight come again."""
    wide, names = set_aside(docs)
    mixed = mix(wide, keep=tuple(names.values()))
    return mixed.repartitionByRange("slot", "offset").sortWithinPartitions("slot", "offset").select(*[F.col(n).alias(c) for c, n in names.items()])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the models nor the packing; tests/llm/test_pipeline.py holds each stage against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, staged = table(spark, sf_dir, "documents"), Staged(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = staged.write(out, name)
    return docs
