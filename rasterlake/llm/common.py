"""Helpers shared by the corpus operators: columns, shared storage, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and the ASCII controls tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, as in tests, a folder of this machine if Spark runs in
    this process alone; on a cluster that would be each executor's own disk, so there it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local") or sc.master.startswith("local-cluster") and not shared:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="rasterlake-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage. The shuffle files of the job go as soon as it has ended."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a plan of its own, made under that setting
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def text_key() -> list:
    """A row's identity: its doc_id (null: the smallest long) and a hash of its text. Rows that share both are the same document twice."""
    return [
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("k0"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k1"),
    ]


#: Buckets by which rows are told apart cheaply before a join.
BUCKETS = 1 << 20


def bucket(*key: str | Column) -> Column:
    """One of BUCKETS numbers. A table of them has a row for each at most, so it may be broadcast whatever the keys' number; rows whose bucket
    isn't in it need not go through the join on the keys themselves."""
    return F.pmod(F.xxhash64(*key), BUCKETS).cast("int")


def release() -> None:
    """Gives what a task has freed back to the system: its worker lives on, beside others, and may be idle for long."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `most` bytes, so that what Python makes of a part doesn't hang on how many rows a batch has."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    release()


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty. bytes.split() and bytes.lower() know ASCII only, as the contracts ask."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
