"""Helpers shared by the operators: sizes, staged tables in the shared folder, Arrow maps."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: the space and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local sessions get a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="streamloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: What stands for a null id where ids are compared: it sorts first.
NO_ID = -(1 << 63)


def id_order(col: str = "doc_id"):
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def id_or_null(col: str):
    return F.when(F.col(col) != NO_ID, F.col(col))


ROW_GROUP, TASK_BYTES = 16 << 20, 128 << 20
#: Local folders without checksum files beside the tables (Parquet pages have their own): a third fewer starts of chmod. Other stores ignore it.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Staged:
    """Tables written to the shared folder, which cut lineage: a lost executor costs a reread, not a recomputation.

    few: the input of the operator. Neighbouring partitions go to one task and file; there are two a core at least, one for
    8 partitions of the session's shuffle width and one for TASK_BYTES of the input. For each file in a local folder, Hadoop
    launches chmod three times (twice with PLAIN), and each launch shows the executor's memory a second time until the new program has started."""

    def __init__(self, spark: SparkSession, tag: str, few: DataFrame | None = None):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        self.files = 0
        if few is not None:
            size = int(str(few._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # as planned; far too much after joins
            self.files = max(2 * spark.sparkContext.defaultParallelism, width(spark, 0, 1) // 8, min(size // TASK_BYTES, 1 << 20))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        # the shuffle files of this write go when it ends: nothing reads them again
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            writer = (df.coalesce(self.files) if self.files else df).write.option("compression", "zstd").options(**PLAIN)
            if self.files:  # larger files in row groups as small as the files were, for the memory of writers and the splits of reads
                writer = writer.option("parquet.block.size", ROW_GROUP)
            writer.parquet(path)
        finally:
            self.spark.conf.unset(key) if was is None else self.spark.conf.set(key, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_part(self, df: DataFrame, name: str) -> DataFrame:
        """A table that holds a part of what the input makes: half as many files, if they are to be few."""
        whole, self.files = self.files, -(-self.files // 2)
        try:
            return self.write(df, name)
        finally:
            self.files = whole

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def width(spark: SparkSession, units: float, per_task: float) -> int:
    """Partitions for so many units: the session's shuffle width, or more where tasks would grow beyond per_task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(units // per_task) + 1)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: what workers remember from task to task stands in a module of this name
KEPT = "_streamloom_kept"


def slices(batches, rows: int = 1000, keep: bool = False):
    """Arrow batches in parts of few rows: texts become Python objects a part at a time. What a task has freed goes back to the
    system when it ends, as workers live on. What a worker remembers goes when it turns to a task that has no use for it
    (without keep)."""
    if not keep:
        sys.modules.pop(KEPT, None)
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
