"""What is derived from the log and kept: deciding records at an instant, and the boots of hosts.

A checkpoint at c holds, for every (subject, producer), the record that decides it just before c, deletes
and lapsed ones too.  The seeds of a later window then need the checkpoint, the records of [c, from), and
records that arrived after the checkpoint was built with event times before it (few: late ones): not the
history.  It is never a fact: it can be built again from the log at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators import fold
from strandlog.operators.log import latest_at
from strandlog.schema import last_of, live_at

#: Rules of the derivations that are kept; a checkpoint of other rules is not used.
VERSION = 1


def checkpoint(log: DataFrame, at_ns: int, through_seq: int) -> DataFrame:
    """The deciding records just before ``at_ns`` among those known at ``through_seq``, without payloads, and what they were built from."""
    known = log.filter(F.col("seq") <= through_seq).drop("payload")
    return latest_at(known, at_ns - 1).drop("subject").withColumns({"version": F.lit(VERSION), "at_ns": F.lit(at_ns).cast("long"), "through_seq": F.lit(through_seq).cast("long")})


def usable(points: DataFrame, from_ns: int, token: int) -> tuple[int, int] | None:
    """(at_ns, through_seq) of the latest checkpoint that a read of [from, ...) at a token may start from."""
    fit = points.filter((F.col("version") == VERSION) & (F.col("at_ns") <= from_ns) & (F.col("through_seq") <= token))
    row = fit.agg(F.max(F.struct("at_ns", "through_seq")).alias("best")).first()["best"]
    return (row["at_ns"], row["through_seq"]) if row else None


def deciding(log: DataFrame, points: DataFrame, from_ns: int, token: int) -> DataFrame:
    """The record that decides each (subject, producer) just before ``from``, as from the whole log."""
    known = log.drop("payload").filter(F.col("seq") <= token)
    best = usable(points, from_ns, token)
    if best is None:
        return latest_at(known, from_ns - 1)
    at_ns, through_seq = best
    held = points.filter((F.col("at_ns") == at_ns) & (F.col("through_seq") == through_seq) & (F.col("version") == VERSION)).select(*known.columns)
    since = known.filter((F.col("event_time_ns") < from_ns) & ((F.col("event_time_ns") >= at_ns) | (F.col("seq") > through_seq)))
    return latest_at(held.unionByName(since), from_ns - 1)


def window_since(log: DataFrame, points: DataFrame, from_ns: int, to_ns: int, token: int) -> DataFrame:
    """Seeds and window of [from, to) as ``operators.log.window_since``, by way of a checkpoint."""
    seeds = deciding(log, points, from_ns, token).filter(live_at(from_ns - 1)).drop("subject").withColumn("part", F.lit("seed"))
    known = log.drop("payload").filter(F.col("seq") <= token)
    inside = known.filter((F.col("event_time_ns") >= from_ns) & (F.col("event_time_ns") < to_ns)).withColumn("part", F.lit("window"))
    return seeds.unionByName(inside.select(*seeds.columns))


def due(log: DataFrame, points: DataFrame, now_ns: int, lag_ns: int = 300_000_000_000, least: int = 64) -> bool:
    """Whether a checkpoint at now - lag pays: as many new records as twice the references held, and ``least`` at least."""
    row = points.agg(F.max("through_seq").alias("seq"), F.count(F.lit(1)).alias("n")).first()
    new = log.filter((F.col("seq") > (row["seq"] or 0)) & (F.col("event_time_ns") < now_ns - lag_ns))
    return new.count() >= max(least, 2 * row["n"])


def boot_state(log: DataFrame, horizon_ns: int, skew_ns: int = 0) -> DataFrame:
    """(source, boot, first_seen, last_seen, newer, collided_at): what retention keeps of the boots seen before a horizon.

    ``newer`` is when the next boot of the host appeared, ``collided_at`` the boot's first sighting more than the skew after that.
    """
    past = log.filter(F.col("event_time_ns") < horizon_ns)
    order = Window.partitionBy("source").orderBy("first_seen", "boot")
    known = fold.boots(past).withColumn("newer", F.lead("first_seen").over(order))
    collided = fold.clone_collisions(past, skew_ns).groupBy("source", "boot").agg(F.min("at").alias("collided_at"))
    return known.join(collided, ["source", "boot"], "left").select("source", "boot", "first_seen", "last_seen", "newer", "collided_at")


def quarantined(state: DataFrame, log: DataFrame, horizon_ns: int, skew_ns: int = 0) -> DataFrame:
    """(source): quarantined hosts from the kept state and the records since, as ``fold.quarantined`` finds from the whole log.

    Sightings kept from before carry on: a boot's next may come after the horizon.
    """
    later = log.filter(F.col("event_time_ns") >= horizon_ns).filter("boot is not null and subject_kind = 'entity' and kind = 'observe'")
    seen = later.select("source", "boot", F.explode(F.array("event_time_ns", last_of())).alias("at")).distinct()
    spans = state.select("source", "boot", "first_seen", "last_seen").unionByName(seen.select("source", "boot", F.col("at").alias("first_seen"), F.col("at").alias("last_seen")))
    boots = spans.groupBy("source", "boot").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    order = Window.partitionBy("source").orderBy("first_seen", "boot")
    boots = boots.withColumn("newer", F.lead("first_seen").over(order))
    now = boots.filter(F.col("last_seen") - F.col("newer") > skew_ns).select("source")
    return now.union(state.filter("collided_at is not null").select("source")).distinct()
