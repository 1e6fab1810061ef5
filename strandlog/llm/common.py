"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None
_made: dict = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests) a temporary folder is made once;
    on a cluster its files would be on one machine, so there that is an error.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="strandlog-")
    return _own_dir


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps what it writes between stages."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of files, not a recomputation, and what
    is read later is fixed even if ``df`` numbered its rows by their place in a partition.
    The tables stay until ``drop_staged``, as later reads need them.
    """
    path = f"{own_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Deletes all that this application has staged; results not yet read are lost with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_one(left: DataFrame, right: DataFrame, key: str, share: int = 10_000, least: int = 1000) -> DataFrame:
    """Inner join of a staged table with one that has one row per key, in which some keys may be very common.

    Keys with more than 1 / ``share`` of all rows of ``left`` (and ``least``) are at most ``share``, so their
    rows of ``right`` are broadcast; their many rows of ``left`` stay where they are.  All others meet by hash.
    """
    limit = max(least, left.count() // share)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(key)
    if not hot.limit(1).count():
        return left.join(right, key)
    hot = F.broadcast(staged(hot, "hot"))
    few = F.broadcast(staged(right.join(hot, key, "left_semi"), "hot"))
    return left.join(few, key).unionByName(left.join(hot, key, "left_anti").join(right, key))


def words_of(text):
    """Array of the words of a text; null and blank texts give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+")
    return F.array_remove(parts, "")


def release() -> None:
    """Hands memory that this process has freed back to the system; idle workers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def only(key=None, make=lambda: None):
    """What a worker process keeps between tasks: the result of ``make`` for the last key, nothing else.

    Workers outlive a stage, so a model of one stage must not stay beside that of the next.
    """
    if key not in _made:
        _made.clear()
        release()
        _made[key] = make()
    return _made[key]


def parts(batches, size: int = 4 << 20, rows: int = 512):
    """Arrow batches in slices of some hundred rows, so that a worker holds few texts as Python objects.

    A slice is cut by its number of rows and, roughly, by the bytes of the batch.
    """
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for first in range(0, batch.num_rows, step):
            yield batch.slice(first, step)
    release()
