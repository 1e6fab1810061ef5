"""Folding assertions into existence: window functions and gaps-and-islands, no driver loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.schema import OPEN, deadline, last_of, live_at, subject_key

REASONS = {2: "producer", 1: "liveness_expiry"}


def effective(log: DataFrame) -> DataFrame:
    """Per subject, producer and event time the record with the highest seq; the others have no effect."""
    w = Window.partitionBy("subject", "producer", "event_time_ns").orderBy(F.desc("seq"))
    return log.withColumn("subject", subject_key()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def segments(log: DataFrame) -> DataFrame:
    """(subject columns, producer, start, end, strength): stretches in which a producer's reference is live.

    strength ranks why it ended: 2 by its producer, 1 by expiry, 0 unknown or open.
    """
    w = Window.partitionBy("subject", "producer").orderBy("event_time_ns")
    e = effective(log.drop("payload")).withColumn("next", F.lead("event_time_ns").over(w)).withColumn("next_kind", F.lead("kind").over(w))
    e = e.filter("kind = 'observe'").withColumn("lapse", deadline())
    lapses = F.col("next").isNull() | ((F.col("ttl_ns") > 0) & (F.col("lapse") < F.col("next")))
    strength = F.when(lapses, F.when(F.col("lapse") == OPEN, 0).otherwise(1)).otherwise(F.when(F.col("next_kind") == "delete", 2).otherwise(0))
    return e.select("subject", "layer", "subject_kind", "source", "target", "relation", "producer", F.col("event_time_ns").alias("start"), F.when(lapses, F.col("lapse")).otherwise(F.col("next")).alias("end"), strength.alias("strength"))


def islands(df: DataFrame, by: list[str], keep: list[str] = (), strength: str | None = None) -> DataFrame:
    """Union of spans [start, end) per group into maximal runs; touching runs are one.

    ``keep``: columns that are the same within a group.  With ``strength``, the run's is the largest
    among the spans that end where it does.
    """
    # Frames by value, so spans that start together always fall into one run.
    w = Window.partitionBy(*by).orderBy("start")
    reached = F.max("end").over(w.rangeBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in keep] + [F.min("start").alias("start")]
    if strength is None:
        return marked.groupBy(*by, "_run").agg(*aggs, F.max("end").alias("end")).drop("_run")
    out = marked.groupBy(*by, "_run").agg(*aggs, F.max(F.struct("end", strength)).alias("_top"))
    return out.select(*by, *keep, "start", F.col("_top.end").alias("end"), F.col(f"_top.{strength}").alias(strength))


SUBJECT = ["layer", "subject_kind", "source", "target", "relation"]


def reason(strength: str = "strength"):
    return F.when(F.col("end") == OPEN, F.lit(None)).when(F.col(strength) == 2, "producer").when(F.col(strength) == 1, "liveness_expiry")


def existence(log: DataFrame) -> DataFrame:
    """(subject columns, start, end, end_source): maximal existence intervals over all producers."""
    out = islands(segments(log), ["subject"], SUBJECT, "strength")
    return out.select("subject", *SUBJECT, "start", "end", reason().alias("end_source"))


def existence_by_producer(log: DataFrame) -> DataFrame:
    out = islands(segments(log), ["subject", "producer"], SUBJECT, "strength")
    return out.select("subject", *SUBJECT, "producer", "start", "end", reason().alias("end_source"))


def describe_at(log: DataFrame, x: int, ranks: DataFrame | None = None) -> DataFrame:
    """(subject, producer, payload, layer, event_time_ns): at x the live producer that outranks the others; recency never decides.

    ``ranks`` (producer, rank): listed beats unlisted, then the higher rank, then the smaller name.
    """
    e = effective(log.filter(F.col("event_time_ns") <= x))
    last = Window.partitionBy("subject", "producer").orderBy(F.desc("event_time_ns"))
    live = e.withColumn("_r", F.row_number().over(last)).filter("_r = 1").filter(live_at(x))
    live = live.join(ranks, "producer", "left") if ranks is not None else live.withColumn("rank", F.lit(None).cast("int"))
    best = Window.partitionBy("subject").orderBy(F.desc_nulls_last("rank"), "producer")
    return live.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("subject", "producer", "payload", "layer", "event_time_ns")


def evidence(log: DataFrame, at: int) -> DataFrame:
    """(subject, producer, event_time_ns, through_ns, ttl_ns, latest): per live producer its deciding record and the last instant seen of it."""
    past = effective(log.drop("payload").filter(F.col("event_time_ns") <= at))
    deciding = F.max_by(F.struct("event_time_ns", "through_ns", "ttl_ns", "kind"), "event_time_ns").alias("r")
    latest = F.max(F.when(F.col("kind") == "observe", last_of())).alias("latest")
    return past.groupBy("subject", "producer").agg(deciding, latest).select("subject", "producer", "r.*", "latest").filter(live_at(at))


def boots(log: DataFrame) -> DataFrame:
    """(source, boot, first_seen, last_seen) of each boot id of each host."""
    hosts = log.filter("boot is not null and subject_kind = 'entity' and kind = 'observe'").withColumn("subject", subject_key())
    seen = hosts.select("source", "boot", F.explode(F.array("event_time_ns", last_of())).alias("at")).distinct()
    return seen.groupBy("source", "boot").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def clone_collisions(log: DataFrame, skew_ns: int = 0) -> DataFrame:
    """(source, boot, at): sightings of a boot more than ``skew_ns`` after a newer boot of its host appeared.

    A host with any is quarantined, whatever the instant asked about.
    """
    b = boots(log)
    order = Window.partitionBy("source").orderBy("first_seen", "boot")
    b = b.withColumn("newer", F.lead("first_seen").over(order))
    hosts = log.filter("boot is not null and subject_kind = 'entity' and kind = 'observe'")
    seen = hosts.select("source", "boot", F.explode(F.array("event_time_ns", last_of())).alias("at")).distinct()
    return seen.join(b.select("source", "boot", "newer"), ["source", "boot"]).filter(F.col("at") - F.col("newer") > skew_ns).select("source", "boot", "at")


def quarantined(log: DataFrame, skew_ns: int = 0) -> DataFrame:
    """(source, boot, at): the first collision of each host that has one."""
    first = Window.partitionBy("source").orderBy("at", "boot")
    return clone_collisions(log, skew_ns).withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def coalesce_runs(log: DataFrame) -> DataFrame:
    """Unchanged refreshes folded into one record per run, with ``through_ns`` at the last of them.

    A refresh continues a run if it has its payload and TTL, starts after the run's last instant and not
    after its deadline.  A continuing record starts after all before it, so ``lag`` sees the run's end.
    """
    e = effective(log)
    w = Window.partitionBy("subject", "producer").orderBy("event_time_ns")
    prev = {c: F.lag(c).over(w) for c in ("kind", "payload", "ttl_ns")}
    prev_last = F.lag(last_of()).over(w)
    goes_on = (
        (F.col("kind") == "observe") & (prev["kind"] == "observe") & F.col("payload").eqNullSafe(prev["payload"]) & (F.col("ttl_ns") == prev["ttl_ns"])
        & (F.col("event_time_ns") > prev_last) & ((F.col("ttl_ns") == 0) | (F.col("event_time_ns") <= prev_last + prev["ttl_ns"]))
    )
    e = e.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_last", last_of())
    e = e.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "event_time_ns").alias(c)
    out = e.groupBy("subject", "producer", "_run").agg(
        F.max("seq").alias("seq"), F.min("event_time_ns").alias("_event"), F.max("_last").alias("_through"),
        *[first(c) for c in ("layer", "subject_kind", "source", "target", "relation", "kind", "ttl_ns", "payload")],
    )
    return out.select("seq", F.col("_event").alias("event_time_ns"), "layer", "subject_kind", "source", "target", "relation", "producer", "kind", "ttl_ns", F.when(F.col("_through") > F.col("_event"), F.col("_through")).alias("through_ns"), "payload")
