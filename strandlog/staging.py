"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, and in it a folder of this application.

    Only where the session names none and runs in one process (tests) a temporary folder is made once;
    on a cluster its files would be on one machine, so there that is an error.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own_dir = named = _own_dir or "file://" + tempfile.mkdtemp(prefix="strandlog-plan-")
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "plan") -> DataFrame:
    """Writes a table and reads it back: what follows rereads files if an executor is lost, and sees fixed rows."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, uri: str):
    """(file system, path) of a URI, whatever store it names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    store, path = hadoop_path(spark, uri)
    return store.exists(path)


def drop_staged(spark: SparkSession) -> None:
    """Deletes all that this application has staged; results not yet read are lost with it."""
    store, path = hadoop_path(spark, shared_folder(spark))
    store.delete(path, True)
