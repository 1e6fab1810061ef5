"""The point and window reads as JSON lines: python -m strandlog.cli LOG neighbors|alive|window|history ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import log as reads, ranges
from strandlog.sources import activity


def neighbors(log: DataFrame, entity: str, t: int, direction: str = "forward") -> DataFrame:
    """Edges of an entity alive at t, ends not checked, by peer and relation."""
    asked = log.sparkSession.createDataFrame([(entity,)], "entity string")
    return ranges.in_order(reads.neighbors(log, asked, t, direction)).orderBy("place").select("entity", "peer", "relation")


def alive(log: DataFrame, entity: str, t: int) -> DataFrame:
    """Whether an entity is alive at t; a quarantined host is an error, never an answer."""
    held = reads.alive(log, [entity], t)
    return held.select(F.col("source").alias("entity"), "alive")


def window(log: DataFrame, from_ns: int, to_ns: int, subject_kind: str = "edge", entity: str | None = None) -> DataFrame:
    """Raw records in [from, to), of one entity's side if it is named."""
    own = log if entity is None else log.filter((F.col("source") == entity) | (F.col("target") == entity))
    return reads.window(own, from_ns, to_ns, subject_kind).select("seq", "event_time_ns", "source", "target", "relation", "producer", "kind", "ttl_ns")


def history(log: DataFrame, entity: str, from_ns: int, to_ns: int) -> DataFrame:
    """Raw existence records of an entity in [from, to)."""
    return window(log, from_ns, to_ns, "entity", entity)


def lines(df: DataFrame) -> DataFrame:
    """(line): each row as one JSON object; nulls are written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("log", help="folder of Parquet records")
    p.add_argument("operation", choices=["neighbors", "alive", "window", "history"])
    p.add_argument("--entity")
    p.add_argument("--at", type=int, help="nanoseconds since 1970")
    p.add_argument("--from", dest="start", type=int, default=0)
    p.add_argument("--to", type=int, default=2**63 - 1)
    p.add_argument("--direction", choices=["forward", "reverse"], default="forward")
    p.add_argument("--token", type=int, help="read as of this seq; one after the last is refused")
    a = p.parse_args(args)
    if a.operation != "window" and not a.entity:
        p.error("--entity is needed")
    spark = SparkSession.builder.getOrCreate()
    log = activity.read(spark, a.log)
    log = reads.visible(log, reads.resolve_token(log, a.token, strict=True))
    t = a.at if a.at is not None else 0
    made = {
        "neighbors": lambda: neighbors(log, a.entity, t, a.direction), "alive": lambda: alive(log, a.entity, t),
        "window": lambda: window(log, a.start, a.to, "edge", a.entity).orderBy("event_time_ns", "seq"), "history": lambda: history(log, a.entity, a.start, a.to).orderBy("event_time_ns", "seq"),
    }[a.operation]()
    for row in lines(made).toLocalIterator():
        sys.stdout.write(row[0] + "\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
