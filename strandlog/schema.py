"""The fact table: one row per assertion about an entity or a directed relation.

Times are whole nanoseconds since 1970 in BIGINT columns: Spark's timestamps hold microseconds only
and an instant t is the window [t, t + 1).  An open end is OPEN inside the engine, where no
arithmetic is done on it, and null in results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN = 2**63 - 1

_TYPES = {"bigint": T.LongType(), "string": T.StringType(), "binary": T.BinaryType(), "int": T.IntegerType()}
RECORD = T.StructType([
    T.StructField(name, _TYPES[kind])
    for name, kind in (x.split() for x in (
        "seq bigint, event_time_ns bigint, layer string, subject_kind string, source string, target string, relation string, "
        "producer string, kind string, ttl_ns bigint, through_ns bigint, payload binary, boot string, event_time_basis int"
    ).split(", "))
])

# The catalog's entity types (id, type, layer, identifying keys in order; ? marks an optional key).
ENTITY_TYPES = [
    (1, "topo.rack", "L0", "topo.rack.id"), (2, "topo.switch", "L0", "topo.switch.id"), (3, "topo.port", "L0", "topo.port.id"),
    (4, "host", "L1", "host.id"), (5, "topo.zone", "L1", "topo.zone.id"), (6, "k8s.node", "L2", "k8s.node.uid"), (7, "k8s.pod", "L2", "k8s.pod.uid"),
    (8, "container", "L2", "container.id"), (9, "process", "L2", "host.id process.pid:int process.creation.time:time"),
    (10, "service.instance", "L2", "service.namespace? service.name service.instance.id"), (11, "service", "L3", "service.namespace? service.name"),
    (12, "topo.endpoint", "L2", "topo.endpoint.realm topo.endpoint.address"),
]
# Relation, from type, to type, propagation, stored layer.
RELATIONS = [
    ("part_of", "container", "k8s.pod", "down", "L2"), ("part_of", "service.instance", "k8s.pod", "down", "L2"),
    ("scheduled_on", "k8s.pod", "k8s.node", "down", "L2"), ("runs_on", "k8s.node", "host", "down", "L1"), ("runs_on", "process", "host", "down", "L1"),
    ("located_in", "host", "topo.rack", "down", "L1"), ("located_in", "host", "topo.zone", "down", "L1"),
    ("instance_of", "service.instance", "service", "none", "L2"), ("depends_on", "service", "service", "up", "L3"),
    ("has_address", "k8s.pod", "topo.endpoint", "none", "L2"), ("has_address", "k8s.node", "topo.endpoint", "none", "L2"),
]
#: Relations whose source is in one place at a time.
SINGLE_CLAIM = ("runs_on", "located_in")


def type_of(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, ":", 1)


def hash_of(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, ":", -1)


def subject_key() -> Column:
    """One string per subject; ids hold no spaces."""
    return F.concat_ws(" ", "source", "relation", "target")


def last_of() -> Column:
    return F.greatest("event_time_ns", F.coalesce("through_ns", "event_time_ns"))


def deadline() -> Column:
    """When an observe lapses; OPEN without a TTL."""
    return F.when(F.col("ttl_ns") == 0, F.lit(OPEN)).otherwise(last_of() + F.col("ttl_ns"))


def live_at(t) -> Column:
    return (F.col("kind") == "observe") & ((F.col("ttl_ns") == 0) | (F.lit(t) < deadline()))


def entity_types(spark) -> DataFrame:
    return spark.createDataFrame(ENTITY_TYPES, "id int, type string, layer string, identifying_keys string")


def relations(spark) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "relation string, from_type string, to_type string, propagation string, layer string")


def edge_layers(entity_type: str, direction: str) -> list[str]:
    """Layers that can hold edges of a type in a direction: the partitions a read needs."""
    side = 1 if direction == "forward" else 2
    return sorted({r[4] for r in RELATIONS if r[side] == entity_type})


def edge_layers_of_types(spark) -> DataFrame:
    """(type, direction, layer) of all types that have an edge layer."""
    rows = [(t, d, layer) for _, t, _, _ in ENTITY_TYPES for d in ("forward", "reverse") for layer in edge_layers(t, d)]
    return spark.createDataFrame(rows, "type string, direction string, layer string")


def reject_reason(df: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: null for a valid record, else the first rule that it breaks."""
    entity, edge = F.col("subject_kind") == "entity", F.col("subject_kind") == "edge"
    layers = F.create_map(*[F.lit(x) for _, t, layer, _ in ENTITY_TYPES for x in (t, layer)])
    delete = F.col("kind") == "delete"
    rules = [
        (F.count(F.lit(1)).over(Window.partitionBy("seq")) > 1, "duplicate seq"),
        (F.col("seq").isNull() | (F.col("seq") < 1), "seq below 1"),
        (~(entity | edge) | F.col("subject_kind").isNull(), "unknown subject kind"),
        (~F.col("kind").isin("observe", "delete") | F.col("kind").isNull(), "unknown kind"),
        (entity & (F.col("target").isNotNull() | F.col("relation").isNotNull()), "entity with a target"),
        (edge & (F.col("target").isNull() | F.col("relation").isNull()), "edge without a target"),
        (entity & (F.coalesce(F.element_at(layers, type_of(F.col("source"))), F.lit("")) != F.col("layer")), "layer is not the type's"),
        (~F.col("producer").rlike("^[A-Za-z0-9._:/-]{1,64}$"), "producer name"),
        (F.col("event_time_ns") < 0, "event time before 1970"), (F.col("ttl_ns") < 0, "negative ttl"), (F.col("through_ns") < F.col("event_time_ns"), "through before event time"),
        (delete & ((F.col("ttl_ns") != 0) | F.col("through_ns").isNotNull() | (F.octet_length("payload") > 0)), "delete with ttl, through or payload"),
        ((F.col("ttl_ns") > 0) & (F.lit(OPEN) - F.col("ttl_ns") < last_of()), "deadline out of range"),
        (F.col("boot").isNotNull() & ~(entity & (type_of(F.col("source")) == "host") & ~delete & (F.octet_length("boot") <= 256)), "boot outside a host observe"),
    ]
    why = F.coalesce(*[F.when(test, F.lit(name)) for test, name in rules])
    return df.withColumn("reject_reason", why)


def edge_violations(spark, log: DataFrame) -> DataFrame:
    """Stored edges whose relation, layer or pair of types the catalog does not allow."""
    allowed = F.broadcast(relations(spark).select("relation", "layer", "from_type", "to_type"))  # eleven rows
    edges = log.filter("subject_kind = 'edge'").withColumn("from_type", type_of(F.col("source"))).withColumn("to_type", type_of(F.col("target")))
    return edges.join(allowed, ["relation", "layer", "from_type", "to_type"], "left_anti").select("seq", "relation", "layer", "source", "target")
