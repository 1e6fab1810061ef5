"""OTLP JSON-lines captures: one request a line, logs or metrics, flattened with JSON functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators.order import numbered

_VALUE = "struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double,kvlistValue:struct<values:array<struct<key:string,value:struct<stringValue:string,intValue:string>>>>>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
LOGS = f"resourceLogs array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,eventName:string,body:{_VALUE},attributes:{_ATTRS}>>>>>>"
METRICS = f"resourceMetrics array<struct<resource:struct<attributes:{_ATTRS}>,scopeMetrics:array<struct<scope:struct<name:string>,metrics:array<struct<name:string,sum:struct<aggregationTemporality:int,isMonotonic:boolean,dataPoints:array<struct<startTimeUnixNano:string,timeUnixNano:string,asInt:string,asDouble:double,attributes:{_ATTRS}>>>>>>>>>"


def attributes(col):
    """array of OTLP attributes as map<string,string>; the last of equal keys counts, nested lists become JSON."""
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"), F.to_json(v["kvlistValue"]))
    entries = F.transform(F.coalesce(col, F.array().cast(_ATTRS)), lambda a: F.struct(a["key"], text(a["value"])))
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(kept)


def read_lines(spark: SparkSession, path: str, streaming: bool = False, max_files: int = 64) -> DataFrame:
    """The raw lines of a folder, as a table or as a stream that takes a bounded number of files at once."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path) if streaming else spark.read.text(path)


def log_records(lines: DataFrame) -> DataFrame:
    """(event_name, time_ns, observed_ns, resource, attrs, body): one row per log record."""
    r = lines.select(F.from_json("value", LOGS).alias("v")).select(F.explode("v.resourceLogs").alias("r"))
    s = r.select(attributes(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeLogs").alias("s"))
    x = s.select("resource", F.explode("s.logRecords").alias("x"))
    return x.select(F.col("x.eventName").alias("event_name"), F.col("x.timeUnixNano").cast("long").alias("time_ns"), F.col("x.observedTimeUnixNano").cast("long").alias("observed_ns"), "resource", attributes(F.col("x.attributes")).alias("attrs"), F.col("x.body.stringValue").alias("body"))


def metric_points(lines: DataFrame) -> DataFrame:
    """(metric, temporality, start_ns, time_ns, value, resource, attrs): one row per number point of a sum."""
    r = lines.select(F.from_json("value", METRICS).alias("v")).select(F.explode("v.resourceMetrics").alias("r"))
    s = r.select(attributes(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeMetrics").alias("s"))
    m = s.select("resource", F.explode("s.metrics").alias("m"))
    p = m.select("resource", F.col("m.name").alias("metric"), F.when(F.col("m.sum.aggregationTemporality") == 1, "delta").otherwise("cumulative").alias("temporality"), F.explode("m.sum.dataPoints").alias("p"))
    return p.select("metric", "temporality", F.col("p.startTimeUnixNano").cast("long").alias("start_ns"), F.col("p.timeUnixNano").cast("long").alias("time_ns"), F.coalesce(F.col("p.asInt").cast("double"), F.col("p.asDouble")).alias("value"), "resource", attributes(F.col("p.attributes")).alias("attrs"))


def in_order(records: DataFrame) -> DataFrame:
    """Adds ``place``: the embedded sequence key if a record has one, the others after them by observation, then time."""
    keys = [F.col("attrs")["sequence"].cast("long").asc_nulls_last(), F.coalesce("observed_ns", "time_ns"), "time_ns", "event_name"]
    return numbered(records, keys, "place")


def log_lines(records: DataFrame) -> DataFrame:
    """(value): JSON lines of log records (request, event_name, time_ns, observed_ns, resource, attrs, body), one request a line.

    A request's records are joined in one row, as they were sent.
    """
    pairs = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    one = F.struct(
        F.col("time_ns").cast("string").alias("timeUnixNano"), F.col("observed_ns").cast("string").alias("observedTimeUnixNano"), F.col("event_name").alias("eventName"),
        F.struct(F.col("body").alias("stringValue")).alias("body"), pairs(F.col("attrs")).alias("attributes"),
    )
    scopes = records.groupBy("request", pairs(F.col("resource")).alias("resource")).agg(F.collect_list(one).alias("logRecords"))
    resource = F.struct(F.struct(F.col("resource").alias("attributes")).alias("resource"), F.array(F.struct("logRecords")).alias("scopeLogs"))
    return scopes.groupBy("request").agg(F.to_json(F.struct(F.collect_list(resource).alias("resourceLogs"))).alias("value")).select("value")


def metric_lines(points: DataFrame) -> DataFrame:
    """(value): JSON lines of sums (request, metric, temporality, start_ns, time_ns, value, attrs), one request a line."""
    pairs = F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    one = F.struct(F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("time_ns").cast("string").alias("timeUnixNano"), F.col("value").cast("double").alias("asDouble"), pairs.alias("attributes"))
    sums = points.groupBy("request", "metric", "temporality").agg(F.collect_list(one).alias("dataPoints"))
    kind = F.when(F.col("temporality") == "delta", 1).otherwise(2)
    metric = F.struct(F.col("metric").alias("name"), F.struct(kind.alias("aggregationTemporality"), F.lit(True).alias("isMonotonic"), "dataPoints").alias("sum"))
    return sums.groupBy("request").agg(F.collect_list(metric).alias("metrics")).select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct("metrics")).alias("scopeMetrics"))).alias("resourceMetrics"))).alias("value"))


def route(records: DataFrame) -> DataFrame:
    """Adds ``route``: host, entity, object or legacy."""
    entity = F.col("event_name").isin("entity.state", "entity.delete")
    return records.withColumn("route", F.when(entity & (F.col("attrs")["entity.type"] == "host"), "host").when(entity, "entity").when(F.col("attrs")["k8s.resource.name"].isNotNull(), "object").otherwise("legacy"))
