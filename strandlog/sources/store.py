"""The log as a folder of Parquet files, laid out for its reads.

Partitioned by layer and kind of subject, and sorted by event time in each file: a read of some layers
opens only theirs, one of a window skips row groups by their smallest and largest event time, and one of a few
entities skips those whose Bloom filter has none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ["layer", "subject_kind"]


def write(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    order = [*PARTITIONS, "event_time_ns", "seq"]
    log.repartitionByRange(*order[:3]).sortWithinPartitions(*order).write.mode(mode).option("compression", "zstd").option("parquet.bloom.filter.enabled#source", "true").partitionBy(*PARTITIONS).parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def layer_sizes(log: DataFrame) -> DataFrame:
    """(layer, subject_kind, records, payload_bytes, key_bytes): what takes the room, by layer and part."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("source", "target", "relation", "producer")]
    sums = F.sum(F.coalesce(F.octet_length("payload"), F.lit(0))).alias("payload_bytes"), F.sum(sum(text[1:], text[0])).alias("key_bytes")
    return log.groupBy("layer", "subject_kind").agg(F.count(F.lit(1)).alias("records"), *sums)
