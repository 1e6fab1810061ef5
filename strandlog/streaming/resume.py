"""First sightings after a restart, re-timed from what is stored: a decision table as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators.log import last_assertion
from strandlog.schema import subject_key
from strandlog.streaming.translate import OBSERVED


def decided(marked: DataFrame, stored: DataFrame, horizons: dict[str, int] | None = None, bound: int | None = None) -> DataFrame:
    """The backdated records with ``decision`` and their new event_time_ns, through_ns and event_time_basis.

    ``marked``: records with ``place``, their order among their producer's.  The newest stored assertion of the same
    subject and producer decides: nothing stored, a deletion before the record's start, or an observe whose last
    instant is not after it leave it as it is (new); a deletion at or after the start drops it; an observe of the same
    description raises it to the last instant, or to when it was observed if that is earlier (raised); one of another
    description, and one that cannot be known, is taken from when it was observed (changed, unknown_...).  No record
    is timed before an earlier one of its subject.
    """
    horizons = horizons or {}
    keyed = marked.withColumn("subject", subject_key())
    refs = keyed.select("subject", "producer").distinct()
    log = stored.withColumn("subject", subject_key())
    newest = log.groupBy("subject", "producer").agg(F.max_by(F.struct("event_time_ns", "through_ns", "kind", "payload", "ttl_ns", "event_time_basis"), F.struct("event_time_ns", "seq")).alias("s"))
    found = last_assertion(stored, refs, horizons, bound).select("subject", "producer", "outcome").join(newest, ["subject", "producer"], "left")
    x = keyed.join(found, ["subject", "producer"], "left")
    start, obs = F.col("event_time_ns"), F.col("through_ns")
    last = F.greatest("s.event_time_ns", F.coalesce("s.through_ns", "s.event_time_ns"))
    backdated = (F.col("kind") == "observe") & (obs > start)
    t = F.least(last, obs)
    limit = F.coalesce(*[F.when(F.col("layer") == k, F.lit(h)) for k, h in horizons.items()], F.lit(None).cast("long")) if horizons else F.lit(None).cast("long")
    same = F.coalesce("payload", F.lit(bytearray())) == F.coalesce("s.payload", F.lit(bytearray()))
    gap = (F.col("s.ttl_ns") > 0) & (obs > last + F.col("s.ttl_ns"))
    decision = (
        F.when(~F.coalesce(backdated, F.lit(False)), "new").when(F.col("outcome") == "none", "new").when(F.col("outcome") == "exhausted", "unknown_exhausted").when(F.col("outcome") == "baseline_only", "unknown_baseline")
        .when((F.col("s.kind") == "delete") & (start <= F.col("s.event_time_ns")), "dropped").when(F.col("s.kind") == "delete", "new").when(last <= start, "new")
        .when(t < limit, "unknown_below_horizon").when(same, "raised").when(gap, "changed_gap").otherwise("changed")
    )
    x = x.withColumn("decision", decision)
    from_obs = F.col("decision").startswith("unknown") | F.col("decision").startswith("changed")
    own = F.when(from_obs, obs).when(F.col("decision") == "raised", t).otherwise(start)
    by_through = F.coalesce(F.col("s.through_ns") > F.col("s.event_time_ns"), F.lit(False))
    basis = F.when(from_obs, OBSERVED).when((F.col("decision") == "raised") & ((obs < last) | by_through), OBSERVED).when(F.col("decision") == "raised", F.col("s.event_time_basis")).otherwise(F.col("event_time_basis"))
    x = x.withColumns({"_own": F.when(F.col("decision") != "dropped", own), "_basis": basis})
    floor = Window.partitionBy("subject", "producer").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.max(F.struct("_own", "_basis")).over(floor)
    time = F.greatest("_own", latest["_own"])
    x = x.withColumns({"_time": time, "_time_basis": F.when(latest["_own"] > F.col("_own"), latest["_basis"]).otherwise(F.col("_basis"))})
    through = F.when(~from_obs & (obs > F.col("_time")), obs)
    keep = [c for c in marked.columns if c not in ("event_time_ns", "through_ns", "event_time_basis")]
    return x.select(*keep, "decision", F.col("_time").alias("event_time_ns"), through.alias("through_ns"), F.col("_time_basis").cast("int").alias("event_time_basis"))
