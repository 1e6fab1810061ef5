"""Comma-separated traces of a public microservice data set as assertion records.

Placement lines have 6 fields: timestamp (ms), service, instance, node and two measurements.  Call lines
have 11: timestamp (ms), trace, rpc id, one unused, type, upstream service and instance, one unused,
downstream service and instance, response time.  No field is quoted.  Lines that cannot be used are told
apart by their first fault, none is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE_NS = 60_000_000_000
# The call types, and the names that stand for an unknown service or instance.
CALL_TYPES = ["rpc", "http", "mc", "db", "mq", "UNKNOWN"]
UNKNOWN = ["UNKNOWN", "UNAVAILABLE"]
UNKNOWN_INSTANCE = "UNKNOWN_POD_"


def _bad_id(x: Column) -> Column:
    return (F.trim(x) == "") | (F.length(x) > 4096) | x.rlike("[\\x00-\\x1f\\x7f]")


def _unknown_instance(x: Column) -> Column:
    return (x == "") | x.isin(UNKNOWN) | x.startswith(UNKNOWN_INSTANCE)


def _split(lines: DataFrame, names: dict[str, int], fate) -> DataFrame:
    f = F.split("value", ",")
    cut = lines.select(f.alias("f")).withColumns({n: F.get("f", k) for n, k in names.items()})
    return cut.withColumn("fate", fate(F.size("f"))).drop("f")


def placements(lines: DataFrame) -> DataFrame:
    """(timestamp, service, instance, node, fate) of each line (value): fate is used, columns, timestamp or empty_id."""
    c = F.col
    fate = lambda n: F.when(n != 6, "columns").when(~c("timestamp").rlike("^[0-9]{1,15}$"), "timestamp").when(_bad_id(c("service")) | _bad_id(c("instance")) | _bad_id(c("node")), "empty_id").otherwise("used")
    return _split(lines, {"timestamp": 0, "service": 1, "instance": 2, "node": 3}, fate)


def calls(lines: DataFrame) -> DataFrame:
    """(timestamp, type, upstream, downstream, fate) of each line: fate is used, columns, shifted, timestamp, empty_id or unknown_endpoint."""
    c = F.col
    unknown = c("upstream").isin(UNKNOWN) | c("downstream").isin(UNKNOWN) | _unknown_instance(c("upstream_instance")) | _unknown_instance(c("downstream_instance"))
    fate = lambda n: F.when(n != 11, "columns").when(~c("type").isin(CALL_TYPES), "shifted").when(~c("timestamp").rlike("^[0-9]{1,15}$"), "timestamp").when(_bad_id(c("upstream")) | _bad_id(c("downstream")), "empty_id").when(unknown, "unknown_endpoint").otherwise("used")
    names = {"timestamp": 0, "type": 4, "upstream": 5, "upstream_instance": 6, "downstream": 8, "downstream_instance": 9}
    return _split(lines, names, fate).select("timestamp", "type", "upstream", "downstream", "fate")


def reduced(placed: DataFrame, called: DataFrame, epoch_ns: int = 0, ttl_ns: int = 3 * MINUTE_NS) -> DataFrame:
    """Records without seqs: what the used lines show in each minute, once: pods on nodes, and calls between services."""
    text = lambda x: F.lit(None).cast("string") if x is None else x

    def row(layer, kind, source, target=None, relation=None):
        return F.struct(F.lit(layer).alias("layer"), F.lit(kind).alias("subject_kind"), source.alias("source"), text(target).alias("target"), text(relation).alias("relation"))

    minute = F.floor(F.col("timestamp").cast("long") / 60_000).alias("minute")
    pod, node, svc = F.concat(F.lit("k8s.pod:"), "instance"), F.concat(F.lit("k8s.node:"), "node"), lambda c: F.concat(F.lit("service:"), c)
    where = placed.filter("fate = 'used'").select(minute, "instance", "node").distinct()
    who = called.filter("fate = 'used'").select(minute, "upstream", "downstream").distinct()
    a = where.select("minute", F.explode(F.array(row("L2", "entity", pod), row("L2", "entity", node), row("L2", "edge", pod, node, F.lit("scheduled_on")))).alias("r"))
    up, down = svc("upstream"), svc("downstream")
    b = who.select("minute", F.explode(F.array(row("L3", "entity", up), row("L3", "entity", down), row("L3", "edge", up, down, F.lit("depends_on")))).alias("r"))
    both = a.unionByName(b).select("minute", "r.*").distinct()
    return both.select((F.col("minute") * MINUTE_NS + epoch_ns).alias("event_time_ns"), "layer", "subject_kind", "source", "target", "relation", F.lit("trace").alias("producer"), F.lit("observe").alias("kind"), F.lit(ttl_ns).cast("long").alias("ttl_ns"))
