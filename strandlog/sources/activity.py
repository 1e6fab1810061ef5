"""Columnar interchange of the log: scan, write, archive, digests, backup cuts, restore and retirement."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.operators.log import gaps
from strandlog.operators.order import numbered
from strandlog.schema import RECORD, last_of, type_of

COLUMNS = [f.name for f in RECORD.fields]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file or folder; an unsigned seq arrives as a decimal and must fit a long."""
    raw = spark.read.parquet(path)
    for f in RECORD.fields:
        raw = raw.withColumn(f.name, F.col(f.name).cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType))
    return raw.select(*COLUMNS)


def _filled(log: DataFrame) -> DataFrame:
    for f in RECORD.fields:
        if f.name not in log.columns:
            log = log.withColumn(f.name, F.lit(0 if f.name == "event_time_basis" else None).cast(f.dataType))
    return log.select(*COLUMNS)


GROUP = 1000  #: records whose digest is kept together


def write(log: DataFrame, path: str, rows: int = GROUP) -> None:
    """Records sorted by seq, one range of seqs a file, under ``records``; digests of groups of ``rows`` under ``groups``."""
    _filled(log).repartitionByRange("seq").sortWithinPartitions("seq").write.option("compression", "zstd").parquet(f"{path}/records")
    group_digests(read(log.sparkSession, f"{path}/records"), rows).write.parquet(f"{path}/groups")


def checked(spark: SparkSession, path: str, rows: int = GROUP) -> DataFrame:
    """(group, records, first_seq, last_seq, digest, ok): the groups of a written folder, and whether their records still have their digests.

    A group of either side that the other lacks is not ok; nor is one whose seqs repeat, as they cannot be ascending then.
    """
    log = read(spark, f"{path}/records")
    kept = spark.read.parquet(f"{path}/groups").select("group", *[F.col(c).alias(f"_{c}") for c in ("records", "digest")])
    now = group_digests(log, rows)
    ok = F.coalesce((F.col("digest") == F.col("_digest")) & (F.col("records") == F.col("_records")) & (F.col("distinct_seqs") == F.col("records")), F.lit(False))
    return now.join(kept, "group", "full").select("group", "records", "first_seq", "last_seq", "digest", ok.alias("ok"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, records): how many records either log has that the other lacks, repeated ones counted."""
    x, y = _filled(a), _filled(b)
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(side).alias("side"), "records")
    return count(x.exceptAll(y), "first").unionByName(count(y.exceptAll(x), "second"))


def archive(log: DataFrame, path: str) -> None:
    """Sorted by subject for scans by layer and subject, partitioned by layer."""
    order = ["layer", "subject_kind", "source", "target", "relation", "producer", "event_time_ns", "seq"]
    log.repartitionByRange(*order[:3]).sortWithinPartitions(*order).write.option("compression", "zstd").partitionBy("layer").parquet(path)


def _number(x: Column, size: int = 8) -> Column:
    return F.unhex(F.substring(F.lpad(F.hex(x.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))


def _text(x: Column) -> Column:
    raw = F.coalesce(x.cast("binary"), F.lit(bytearray()))
    return F.concat(_number(F.octet_length(raw), 4), raw)


def record_bytes() -> Column:
    """The canonical encoding of a record: big-endian numbers, length-prefixed strings, presence bytes."""
    there = lambda c: F.when(F.col(c).isNotNull(), F.lit(bytearray(b"\1"))).otherwise(F.lit(bytearray(b"\0")))
    return F.concat(
        _number(F.col("seq")), _number(F.col("event_time_ns")), *[_text(F.col(c)) for c in ("layer", "subject_kind", "source", "target", "relation", "producer", "kind")],
        _number(F.col("ttl_ns")), there("through_ns"), _number(F.coalesce("through_ns", F.lit(0))), _text(F.col("payload")), there("boot"), _text(F.col("boot")),
        _number(F.coalesce("event_time_basis", F.lit(0)), 4),
    )


def group_digests(log: DataFrame, rows: int = GROUP) -> DataFrame:
    """(group, records, first_seq, last_seq, distinct_seqs, digest): SHA-256 of the encodings of ``rows`` records each, in seq order.

    A group is a block of ``rows`` dense places; each is joined in one row of bounded size.
    """
    placed = numbered(_filled(log).select("seq", F.hex(record_bytes()).alias("hex")), ["seq", "hex"], "place")
    placed = placed.withColumn("group", F.floor((F.col("place") - 1) / rows))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hex"))), lambda x: x["hex"]), "")
    parts = placed.groupBy("group").agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count_distinct("seq").alias("distinct_seqs"), in_order.alias("hex"))
    return parts.select("group", "records", "first_seq", "last_seq", "distinct_seqs", F.sha2(F.unhex("hex"), 256).alias("digest"))


def class_of() -> Column:
    """Backup class of a record: host entities apart, else the layer in lower case."""
    host = (F.col("subject_kind") == "entity") & (type_of(F.col("source")) == "host")
    return F.when(host, "hosts").otherwise(F.lower("layer"))


def cut(log: DataFrame, path: str, after: int, upto: int, generation: int) -> dict:
    """One generation of a backup: seqs (after, upto] as Parquet by class, then the manifest that commits it.

    Files lie under ``files``, manifests beside them under ``manifests``.  A generation without its manifest
    does not count, and a cut that is made again replaces its files.
    """
    part = _filled(log).filter((F.col("seq") > after) & (F.col("seq") <= upto)).withColumn("class", class_of())
    part.repartitionByRange("class", "seq").sortWithinPartitions("seq").write.mode("overwrite").option("compression", "zstd").partitionBy("class").parquet(f"{path}/files/generation={generation}")
    counts = {r["class"]: {"records": r["n"], "min_seq": r["a"], "max_seq": r["b"]} for r in part.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).collect()}
    manifest = {"version": 1, "generation": generation, "after": after, "upto": upto, "classes": counts}
    log.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifests/generation={generation}")
    return manifest


MANIFEST = "version int, generation int, after long, upto long, classes map<string,struct<records:long,min_seq:long,max_seq:long>>"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(generation, after, upto, class, records, min_seq, max_seq): what the committed generations say they hold."""
    read_back = spark.read.text(f"{path}/manifests").select(F.from_json("value", MANIFEST).alias("m")).select("m.*")
    return read_back.select("generation", "after", "upto", F.explode_outer("classes").alias("class", "c")).select("generation", "after", "upto", "class", "c.records", "c.min_seq", "c.max_seq")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The records of all committed generations; in any order, as seqs give theirs.

    Refused if the chain of generations has a gap or overlaps, or if a class does not hold the records that
    its manifest counts.
    """
    said = manifests(spark, path)
    chain = sorted({(r["generation"], r["after"], r["upto"]) for r in said.select("generation", "after", "upto").distinct().collect()})  # one row a generation
    for (_, _, upto), (generation, after, _) in zip(chain, chain[1:]):
        if after != upto:
            raise ValueError(f"generation {generation} starts after {after}, not {upto}")
    if not chain:
        raise ValueError("no generation is committed")
    raw = spark.read.option("basePath", f"{path}/files").parquet(*[f"{path}/files/generation={g}" for g, _, _ in chain])
    found = raw.groupBy(F.col("class")).agg(F.count(F.lit(1)).alias("n"))
    wrong = said.groupBy("class").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records")).filter("class is not null").join(found, "class", "full").filter("not records <=> n").limit(1).collect()
    if wrong:
        raise ValueError(f"class {wrong[0]['class']} holds {wrong[0]['n']} records, not {wrong[0]['records']}")
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD.fields])


def dense(log: DataFrame) -> bool:
    return gaps(log).limit(1).count() == 0


def retirable(files: DataFrame, horizon_ns: int, margin_ns: int) -> DataFrame:
    """(class, file, retire): the longest prefix of a class's files that may go.

    ``files``: (class, file, reach, first_observe): per file in order its largest reach, and the least
    event time of its observes that a dropped record could shadow.  A file may go if its reach is at
    least the margin before the horizon, all before it may go, and no observe left starts before the
    reach of what goes.
    """
    w = Window.partitionBy("class").orderBy("file")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    f = files.withColumn("_ok", F.min((F.col("reach") <= horizon_ns - margin_ns).cast("int")).over(before))
    f = f.withColumn("_reach", F.max("reach").over(before)).withColumn("_left", F.min("first_observe").over(after))
    f = f.withColumn("_cut", (F.col("_ok") == 1) & (F.col("_left").isNull() | (F.col("_reach") <= F.col("_left"))))
    last = F.max(F.when(F.col("_cut"), F.col("file"))).over(Window.partitionBy("class"))
    retire = F.coalesce(F.col("file") <= last, F.lit(False)) & ~F.col("class").isin("l0", "hosts")
    return f.select("class", "file", retire.alias("retire"))


def file_reach(log: DataFrame, files: int) -> DataFrame:
    """Reach per class and seq range, as input of ``retirable``: ``files`` ranges of a class, as even as can be.

    Records are numbered by (class, seq) over all tasks, and a class's range is found from its first number.
    """
    keyed = numbered(log.withColumn("class", class_of()), ["class", "seq"], "place")
    sizes = F.broadcast(keyed.groupBy("class").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n")))  # five classes
    own, small = F.col("place") - F.col("_first"), F.floor(F.col("_n") / files)
    more = F.col("_n") % files  # this many ranges hold one record more
    file = F.when(own < more * (small + 1), F.floor(own / (small + 1))).otherwise(more + F.floor((own - more * (small + 1)) / F.greatest(small, F.lit(1)))) + 1
    placed = keyed.join(sizes, "class").withColumn("file", file.cast("int"))
    return placed.groupBy("class", "file").agg(F.max(last_of()).alias("reach"), F.min(F.when(F.col("kind") == "observe", F.col("event_time_ns"))).alias("first_observe"))


def replay(log: DataFrame, path: str, batch: int = 100_000, done: int = 0) -> int:
    """Writes the records after ``done`` to a folder, parted by batches of seqs, in one pass over the log; returns the last seq.

    A batch that is written again replaces itself, so a replay that failed is repeated from the last batch known to be whole.
    """
    rest = _filled(log).filter(F.col("seq") > done).withColumn("batch", F.floor((F.col("seq") - 1) / batch))
    rest.repartitionByRange("batch").sortWithinPartitions("batch", "seq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    return log.agg(F.max("seq")).first()[0] or done
