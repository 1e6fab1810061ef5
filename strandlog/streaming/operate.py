"""What ingest watches over: shared cluster names, gaps and silence, when to retain, and the commit of a batch."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.operators.order import numbered
from strandlog.schema import reject_reason
from strandlog.staging import exists

DAY_NS = 86_400_000_000_000
HOUR_NS = 3_600_000_000_000


# -- clusters that share a name ------------------------------------------------------------------------
def alive_at(sightings: DataFrame, t: int, default_alive_ns: int) -> DataFrame:
    """(cluster, uid, until): uids alive at t, by the newest sighting of each not after it.

    ``sightings``: (cluster, uid, at, deleted, alive_until); at one instant a deletion wins.
    """
    past = sightings.filter(F.col("at") <= t)
    newest = past.groupBy("cluster", "uid").agg(F.max_by(F.struct("at", "deleted", "alive_until"), F.struct("at", "deleted")).alias("s"))
    until = F.when(F.col("s.deleted"), F.col("s.at")).otherwise(F.coalesce("s.alive_until", F.col("s.at") + default_alive_ns))
    return newest.select("cluster", "uid", until.alias("until")).filter(F.col("until") > t)


def shared_names(sightings: DataFrame, t: int, default_alive_ns: int, warm_from: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((cluster, uids) names that two uids hold at t, which are refused; (uid, clusters) uids under two names, which are noted); none of either before ``warm_from``."""
    alive = alive_at(sightings, t, default_alive_ns)
    if warm_from is not None and t < warm_from:
        alive = alive.limit(0)
    refused = alive.groupBy("cluster").agg(F.count_distinct("uid").alias("uids")).filter("uids > 1")
    noted = alive.groupBy("uid").agg(F.count_distinct("cluster").alias("clusters")).filter("clusters > 1")
    return refused, noted


@dataclass(frozen=True)
class NameDecision:
    record: bool = False  #: write the configured name before ingest starts
    ingest: bool = True
    warning: bool = False  #: the acceptance named another value and counts for nothing


def name_decision(recorded: str | None, has_key: bool, last_seq: int, configured: str | None, accept: str | None = None) -> NameDecision:
    """Whether ingest may start under a cluster name; None stands for no name.

    A store with records keeps its name unless the change is accepted by naming the configured one ('' for none).
    """
    accepted = accept is not None and accept == (configured or "")
    warning = accept is not None and not accepted
    if not has_key and last_seq == 0:
        return NameDecision(record=True, warning=warning)
    if has_key and recorded == configured:
        return NameDecision(warning=warning)
    return NameDecision(record=True) if accepted else NameDecision(ingest=False, warning=warning)


# -- gaps and silence -------------------------------------------------------------------------------------
def pull_gaps(pulls: DataFrame, by: list[str], interval_ns: int) -> DataFrame:
    """Generations (by, at), each once, more than one and a half intervals after the one before, with ``gap``."""
    w = Window.partitionBy(*by).orderBy("at")
    return pulls.select(*by, "at").distinct().withColumn("gap", F.col("at") - F.lag("at").over(w)).filter(F.col("gap") * 2 > 3 * interval_ns)


def silent(pulls: DataFrame, by: list[str], now_ns: int, interval_ns: int) -> DataFrame:
    """Keys not heard of for more than three intervals."""
    return pulls.groupBy(*by).agg(F.max("at").alias("last")).filter(now_ns - F.col("last") > 3 * interval_ns)


# -- retention ---------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Retention:
    """What a check of the schedule decides: a horizon to retain to, or why none."""

    horizon_ns: int | None
    reason: str


def agreement(clock_ns: int, newest_ns: int | None, uptime_since_ns: int) -> str:
    """Whether the ingest clock agrees with the newest time that another machine's clock stamped, moved on by the uptime since."""
    if newest_ns is None:
        return "unknown"
    return "agree" if abs(newest_ns + uptime_since_ns - clock_ns) <= DAY_NS else "disagree"


def retention(clock_ns: int, stored_ns: int | None, agrees: str, keep_ns: int = 30 * DAY_NS, pending: bool = False, failed: bool = False, capped_days: int = 2, since_capped_ns: int | None = None) -> Retention:
    """Whether to retain now, and to where: once the target (the clock less what is kept, whole hours) is a day past the stored horizon.

    Far ahead with clocks that agree it catches up at once, with an unknown agreement by two days a day of uptime;
    with clocks that disagree nothing moves.  Horizons never move back.
    """
    target = (clock_ns - keep_ns) // HOUR_NS * HOUR_NS
    if failed:
        return Retention(None, "stopped")
    if agrees == "disagree":
        return Retention(None, "disagree")
    if stored_ns is None:
        return Retention(target, "first") if agrees == "agree" else Retention(None, "unknown")
    if target < stored_ns + DAY_NS:
        return Retention(None, "not due")
    if pending:
        return Retention(None, "pending")
    if target <= stored_ns + capped_days * DAY_NS:
        return Retention(target, "due")
    if agrees == "agree":
        return Retention(target, "catch up")
    if since_capped_ns is not None and since_capped_ns < DAY_NS:
        return Retention(None, "capped already")
    return Retention(stored_ns + capped_days * DAY_NS, "capped")


def newest_of_others(records: DataFrame) -> DataFrame:
    """(newest_ns): the newest event time that another machine's clock stamped; span counts and derived times do not count."""
    others = records.filter(F.col("event_time_basis").isin(2, 4) & ~F.col("producer").startswith("spancount/"))
    return others.agg(F.max("event_time_ns").alias("newest_ns"))


# -- commits -------------------------------------------------------------------------------------------------
def fates(records: DataFrame) -> DataFrame:
    """(fate, n) of log records by their route and what the translators set aside."""
    return records.groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


def committed(spark: SparkSession, path: str) -> list[dict]:
    """The commits of a folder in order: batch, first_seq, last_seq, records."""
    if not exists(spark, f"{path}/commits"):
        return []
    return sorted((json.loads(r[0]) for r in spark.read.text(f"{path}/commits").collect()), key=lambda m: m["batch"])  # one row a batch


def commit(batch: DataFrame, batch_id: int, path: str, order: list) -> dict:
    """Numbers the valid records of a micro-batch after the last committed seq, writes them, then the commit that makes them count.

    Run again, a batch gets the numbers it had; invalid records go to ``rejected`` with the reason.  A reader takes
    the folders of committed batches only.
    """
    spark = batch.sparkSession
    before = [m for m in committed(spark, path) if m["batch"] < batch_id]
    last = max((m["last_seq"] for m in before), default=0)
    made = numbered(batch, order, "seq", last)
    checked = reject_reason(made)
    good = checked.filter("reject_reason is null").drop("reject_reason", "seq")
    numbered(good, order, "seq", last).write.mode("overwrite").parquet(f"{path}/records/batch={batch_id}")
    checked.filter("reject_reason is not null").drop("seq").write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
    n = spark.read.parquet(f"{path}/records/batch={batch_id}").count()
    entry = {"batch": batch_id, "first_seq": last + 1, "last_seq": last + n, "records": n}
    spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/commits/batch={batch_id}")
    return entry


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    folders = [f"{path}/records/batch={m['batch']}" for m in committed(spark, path)]
    if not folders:
        raise ValueError("nothing is committed")
    return spark.read.parquet(*folders)


def committing_sink(path: str, order: list):
    """foreachBatch function: every micro-batch is committed once, however often it runs."""

    def write(batch: DataFrame, batch_id: int) -> None:
        commit(batch, batch_id, path, order)

    return write
