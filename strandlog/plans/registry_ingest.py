"""Registered queries of the ingest operators over telemetry made of the events table, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlog.operators import fold, log as reads
from strandlog.plans.registry import FROM, ORACLE as _BASE, T, _A, _latest
from strandlog.plans.registry_answers import _several
from strandlog.schema import OPEN
from strandlog.sources import capture, fixtures
from strandlog.staging import new_path, staged
from strandlog.streaming import coalescer, operate, resume, translate

DAY, HOUR, MINUTE = 86_400_000_000_000, 3_600_000_000_000, 60_000_000_000
MIDDLE = 9000
CREATED = 1703980800000000000  #: 2023-12-31


def plain(entity_type: str, attributes: dict[str, Column]) -> Column:
    """Readable ids in place of hashes: the type and the values in the order of the keys."""
    values = [F.coalesce(attributes[k], F.lit("")) for k in sorted(attributes)]
    return F.concat(F.lit(f"{entity_type}:"), F.concat_ws("/", *values))


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet").withColumn("ns", F.expr(fixtures.NS.format("ts")))


def sm2_partial_success(s, d):
    """Store records, ten to a log record: one bad one rejects its ten."""
    ok, bad = coalescer.partial_success(_events(s, d).withColumn("log_id", F.floor(F.col("event_id") / 10)), F.col("user_id") % 50 == 0)
    return ok.select("event_id", F.lit(True).alias("accepted")).unionByName(bad.select("event_id", F.lit(False).alias("accepted")))


def sm3_refused_requests(s, d):
    """Requests of a hundred records, refused whole if one names another cluster."""
    e = _events(s, d).withColumns({"request": F.floor(F.col("event_id") / 100), "cluster": F.when(F.col("user_id") == 7, "other").otherwise("own")})
    ok, bad = coalescer.partial_success(e, F.col("cluster") != "own", "request")
    return ok.groupBy("request").agg(F.count(F.lit(1)).alias("records")).withColumn("refused", F.lit(False)).unionByName(bad.groupBy("request").agg(F.count(F.lit(1)).alias("records")).withColumn("refused", F.lit(True)))


def sm4_routes(s, d):
    e = _events(s, d)
    attrs = F.map_filter(F.create_map(F.lit("entity.type"), F.when(F.col("event_type") == "click", "host").when(F.col("event_type") == "view", "k8s.pod"), F.lit("k8s.resource.name"), F.when(F.col("event_type") == "error", "pods")), lambda k, v: v.isNotNull())
    r = e.select(F.when(F.col("event_type").isin("click", "view"), "entity.state").alias("event_name"), attrs.alias("attrs"), "event_id")
    return capture.route(r).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def _runs(s, d):
    """Runs as the coalescer holds them: stored at their first record, seen until their last."""
    runs = fold.coalesce_runs(fixtures.placements(s, d)).filter("kind = 'observe' and ttl_ns > 0")
    subject = F.concat_ws(" ", "source", "relation", "target")
    return runs.select(subject.alias("subject"), "producer", F.col("event_time_ns").alias("start"), F.coalesce("through_ns", "event_time_ns").alias("last"), F.col("event_time_ns").alias("stored"), F.col("ttl_ns").alias("ttl"))


def sm6_flushed(s, d):
    return coalescer.flushed(_runs(s, d), T)


def sm7_prunable(s, d):
    return coalescer.prunable(_runs(s, d), T, FROM).select("subject", "producer", "start")


def sm8_extension(s, d):
    return fixtures.placements(s, d).filter("ttl_ns > 0").select("ttl_ns").distinct().select("ttl_ns", coalescer.extension_ns(F.col("ttl_ns")).alias("extension_ns"))


def _marked(s, d):
    """Records that arrived late in the log, taken as first sightings after a restart: seen now, backdated by six hours."""
    log = fixtures.placements(s, d)
    late = log.filter((F.col("seq") > MIDDLE) & (F.col("subject_kind") == "entity") & (F.col("kind") == "observe")).filter("source like 'k8s.pod:%'")
    return late.withColumns({"place": F.col("seq"), "through_ns": F.col("event_time_ns"), "event_time_ns": F.col("event_time_ns") - 6 * HOUR, "event_time_basis": F.lit(1)}), log.filter(F.col("seq") <= MIDDLE).withColumn("event_time_basis", F.lit(2))


def sm9_resumed(s, d):
    marked, stored = _marked(s, d)
    return resume.decided(marked, stored, {"L2": FROM}).select("seq", "decision", "event_time_ns", "through_ns", "event_time_basis")


def _calls(s, d):
    """A counter per user that starts anew every ten days; values rise, fall and repeat."""
    e = _events(s, d)
    return e.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("series"), F.when(F.col("event_id") % 10 == 0, "delta").otherwise("cumulative").alias("temporality"), F.floor(F.col("ns") / (10 * DAY)).alias("start_ns"), F.col("ns").alias("time_ns"), (F.col("event_id") % 4).cast("double").alias("value"))


def sm10_counter_sightings(s, d):
    return coalescer.counter_sightings(_calls(s, d), idle_ns=DAY // 4, warm_from=FROM, evict_ns=DAY)


def sm10_call_fates(s, d):
    e = _events(s, d)
    kind = F.when(F.col("event_id") % 5 == 0, "database").when(F.col("event_id") % 7 == 0, F.lit(None).cast("string")).otherwise("")
    attrs = F.map_filter(F.create_map(F.lit("connection_type"), kind, F.lit("client"), F.when(F.col("user_id") % 9 == 0, " ").otherwise("a"), F.lit("server"), F.lit("b"), F.lit("virtual_node"), F.when(F.col("event_id") % 11 == 0, "client").otherwise("")), lambda k, v: v.isNotNull())
    return operate.fates(translate.call_fates(e.select(F.lit(translate.REQUESTS).alias("metric"), F.col("ns").alias("time_ns"), attrs.alias("attrs"))))


def _spans(s, d):
    e = _events(s, d)
    resource = F.map_filter(F.create_map(
        F.lit("service.name"), F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")), F.lit("service.instance.id"), F.when(F.col("user_id") % 13 > 0, F.concat(F.lit("i"), F.col("user_id").cast("string"))),
        F.lit("k8s.pod.uid"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("p"), F.col("user_id").cast("string"))), F.lit("service.version"), F.lit("1"),
    ), lambda k, v: v.isNotNull())
    return e.select(F.lit(translate.SPAN_COUNT).alias("metric"), F.when(F.col("event_id") % 6 > 0, "delta").otherwise("cumulative").alias("temporality"), F.col("ns").alias("time_ns"), (F.col("event_id") % 3).cast("double").alias("value"), resource.alias("resource"))


def sm12_span_sightings(s, d):
    return translate.span_sightings(_spans(s, d), "c", HOUR, plain).select("event_time_ns", "layer", "source", "target", "relation", "ttl_ns", "payload")


def sm12_span_fates(s, d):
    return operate.fates(translate.span_fates(_spans(s, d)))


def _objects(s, d):
    """Listed and watched pods from events (an error deletes the pod) and listed nodes; two nodes bear the name n3."""
    e = _events(s, d)
    k = F.get_json_object("props", "$.k").cast("long")
    item = F.struct(
        F.lit("Pod").alias("kind"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"), F.concat(F.lit("pod"), F.col("user_id").cast("string")).alias("name"), F.lit("2023-12-31T00:00:00Z").alias("creationTimestamp")).alias("metadata"),
        F.struct(F.concat(F.lit("n"), (k % 25).cast("string")).alias("nodeName")).alias("spec"),
        F.struct(F.col("event_type").alias("phase"), F.concat(F.lit("10.0."), (F.col("user_id") % 4).cast("string"), F.lit(".1")).alias("podIP"), F.array(F.struct(F.lit("c").alias("name"), F.concat(F.lit("run://b"), F.col("user_id").cast("string")).alias("containerID"))).alias("containerStatuses")).alias("status"),
    )
    body = F.when(F.col("event_type") == "error", F.to_json(F.struct(F.lit("DELETED").alias("type"), item.alias("object")))).otherwise(F.to_json(item))
    pods = e.select(F.col("ns").alias("observed_ns"), F.col("event_id").alias("place"), body.alias("body"))
    n = s.read.parquet(f"{d}/nation.parquet")
    name = F.when(F.col("n_nationkey") == 24, "n3").otherwise(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    node = F.struct(F.lit("Node").alias("kind"), F.struct(F.concat(F.lit("nu"), F.col("n_nationkey").cast("string")).alias("uid"), name.alias("name"), F.lit("2023-12-31T00:00:00Z").alias("creationTimestamp")).alias("metadata"), F.struct(F.array(F.struct(F.lit("InternalIP").alias("type"), F.concat(F.lit("192.168.0."), F.col("n_nationkey").cast("string")).alias("address"))).alias("addresses")).alias("status"))
    return pods.unionByName(n.select(F.lit(fixtures.JANUARY_NS).alias("observed_ns"), F.col("n_nationkey").cast("long").alias("place"), F.to_json(node).alias("body")))


def _object_records(s, d):
    return fixtures.once(s, d, "objects", lambda: staged(translate.objects(_objects(s, d), "c", 30 * DAY, plain), "objects"))


def sm13_object_records(s, d):
    """Pods and nodes of listed and watched objects."""
    return _object_records(s, d).filter("subject_kind = 'entity' and (source like 'k8s.pod:%' or source like 'k8s.node:%')").select("event_time_ns", "source", "kind", "ttl_ns", "through_ns", "event_time_basis")


def sm13_object_fates(s, d):
    return translate.object_fates(_objects(s, d))


def sm14_event_times(s, d):
    """Containers and their part_of follow the times of their pod, and end with it."""
    return _object_records(s, d).filter("source like 'container:%'").select("event_time_ns", "source", "target", "kind", "through_ns")


def sm15_pending(s, d):
    rows = translate.timed(translate.watched(_objects(s, d)).filter("read = 'used'").drop("read"))
    return translate.pending(rows, 30 * DAY)


def sm16_cluster_records(s, d):
    """Entity events of pods: states and deletions, with the pod's creation told."""
    e = _events(s, d)
    pairs = lambda m: F.to_json(F.struct(F.transform(F.map_entries(m), lambda x: F.struct(x["key"].alias("key"), F.struct(x["value"].alias("stringValue")).alias("value"))).alias("values")))
    said = F.create_map(F.lit("k8s.pod.name"), F.concat(F.lit("pod"), F.col("user_id").cast("string")), F.lit("k8s.pod.phase"), F.col("event_type"), F.lit("pod.creation_timestamp"), F.lit("2023-12-31T00:00:00Z"), F.lit("label"), F.lit("x"))
    attrs = F.create_map(F.lit("entity.type"), F.lit("k8s.pod"), F.lit("entity.id"), pairs(F.create_map(F.lit("k8s.pod.uid"), F.concat(F.lit("u"), F.col("user_id").cast("string")))), F.lit("entity.description"), pairs(said), F.lit("entity.report.interval"), F.lit("300"))
    r = e.select(F.when(F.col("event_type") == "error", "entity.delete").otherwise("entity.state").alias("event_name"), F.col("ns").alias("time_ns"), F.col("event_id").alias("place"), attrs.alias("attrs"))
    return translate.cluster_records(r, "c", 300, plain).select("event_time_ns", "source", "kind", "ttl_ns", "through_ns", "payload", "event_time_basis")


def sm17_host_records(s, d):
    e = _events(s, d)
    resource = F.map_filter(F.create_map(
        F.lit("host.id"), F.when(F.col("user_id") % 10 > 0, F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string"))), F.lit("k8s.node.uid"), F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("n"), F.col("user_id").cast("string"))),
        F.lit("topo.host.boot.id"), F.lit("b1"), F.lit("host.arch"), F.lit("amd64"), F.lit("os.type"), F.lit(""), F.lit("host.name"), F.lit("secret"), F.lit("cloud.provider"), F.lit("x"), F.lit("cloud.region"), F.lit("y"), F.lit("cloud.availability_zone"), F.when(F.col("user_id") % 2 > 0, "z"),
    ), lambda k, v: v.isNotNull())
    r = e.select(F.when(F.col("event_type") == "error", "entity.delete").otherwise("entity.state").alias("event_name"), F.col("ns").alias("time_ns"), resource.alias("resource"), F.create_map(F.lit("entity.type"), F.lit("host")).alias("attrs"))
    return translate.host_records(r, "c", 5 * MINUTE, zones=True, ident=plain).select("event_time_ns", "layer", "source", "target", "relation", "ttl_ns", "payload", "boot")


def sm18_address_claims(s, d):
    """Claims of addresses by pods and nodes, and their ends."""
    return _object_records(s, d).filter("relation = 'has_address'").select("event_time_ns", "source", "target", "kind")


def sm18_claimed_twice(s, d):
    """Addresses that two of the nodes' objects claim at once, read as one holder each: four addresses for all pods."""
    rows = translate.timed(translate.watched(_objects(s, d)).filter("read = 'used'").drop("read"))
    return translate.claimed_twice(rows, "c", 30 * DAY).groupBy("address").agg(F.min("start").alias("first"))


def sm19_shared_names(s, d):
    """Clusters (users modulo 20) under whose name two uids are alive at an instant."""
    e = _events(s, d)
    sightings = e.select(F.concat(F.lit("c"), (F.col("user_id") % 20).cast("string")).alias("cluster"), (F.col("user_id") % 3).cast("string").alias("uid"), F.col("ns").alias("at"), (F.col("event_type") == "error").alias("deleted"), F.lit(None).cast("long").alias("alive_until"))
    refused, noted = operate.shared_names(sightings, T, DAY)
    return refused.select(F.lit("refused").alias("what"), F.col("cluster").alias("key"), F.col("uids").alias("n")).unionByName(noted.select(F.lit("noted").alias("what"), F.col("uid").alias("key"), F.col("clusters").alias("n")))


def sm21_newest_of_others(s, d):
    log = fixtures.placements(s, d).withColumn("event_time_basis", F.when(F.col("producer") == "p1", 3).otherwise(4))
    return operate.newest_of_others(log)


def sm22_pull_gaps(s, d):
    e = _events(s, d).select("event_type", F.col("ns").alias("at"))
    return operate.pull_gaps(e, ["event_type"], HOUR // 3)


def sm23_silent(s, d):
    e = _events(s, d).select("user_id", F.col("ns").alias("at"))
    return operate.silent(e.filter(F.col("at") < T), ["user_id"], T, HOUR)


def sm24_fates(s, d):
    """What the host translator sets aside, counted by reason."""
    e = _events(s, d)
    attrs = F.map_filter(F.create_map(F.lit("entity.type"), F.when(F.col("event_type") == "view", "k8s.pod").otherwise("host"), F.lit("otel.entity.type"), F.when(F.col("event_type") == "signup", "host")), lambda k, v: v.isNotNull())
    r = e.select(F.when(F.col("event_type") == "error", "entity.delete").when(F.col("event_type") == "purchase", F.lit(None).cast("string")).otherwise("entity.state").alias("event_name"), F.create_map(F.lit("host.id"), F.when(F.col("user_id") % 2 == 0, " ").otherwise("h")).alias("resource"), attrs.alias("attrs"))
    return operate.fates(translate.host_fates(r))


def sm1_committed(s, d):
    """Four micro-batches, the third of them run twice: numbers of what is committed."""
    log, path = fixtures.placements(s, d).drop("seq").withColumn("boot", F.lit(None).cast("string")), new_path(s, "commits")
    n = F.pmod(F.xxhash64("source", "event_time_ns", "producer", "relation"), F.lit(3))
    for batch, part in enumerate([0, 1, 2, 2]):
        operate.commit(log.filter(n == part), min(batch, 2), path, ["event_time_ns", "source", "subject_kind"])
    return operate.read_committed(s, path).agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_distinct("seq").alias("seqs"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and not k.startswith("_") and k.startswith("sm") and getattr(f, "__module__", "") == __name__}

_EV = "e as (select *, epoch_ns(ts) ns from events)"
_ROUTE = "case when event_type = 'click' then 'host' when event_type = 'view' then 'entity' when event_type = 'error' then 'object' else 'legacy' end"
_RUNS = _BASE["lf10_coalesce"].replace("select max(seq) seq, min(event_time_ns) event_time_ns, min(source) source", "select subject, min(event_time_ns) \"start\", max(lst) \"last\", min(event_time_ns) stored, min(ttl_ns) ttl, min(source) source").replace("min(target) target, producer, min(kind) kind, min(ttl_ns) ttl_ns, case when max(lst) > min(event_time_ns) then max(lst) end through_ns", "producer, min(kind) kind")
_RESUME = f"""with {_A}, m as (select seq place, seq, concat_ws(' ', source, relation, target) subject, producer, event_time_ns - {6 * HOUR} st, event_time_ns obs, payload from a where seq > {MIDDLE} and subject_kind = 'entity' and kind = 'observe' and source like 'k8s.pod:%'),
{_latest("l", f"(select * from a where seq <= {MIDDLE} and subject_kind = 'entity')", OPEN)},
x as (select m.*, l.source is null nothing, l.kind lk, l.event_time_ns le, greatest(l.event_time_ns, coalesce(l.through_ns, l.event_time_ns)) ll, coalesce(l.through_ns, 0) > l.event_time_ns bt, l.payload lp, l.ttl_ns lt from m left join l on concat_ws(' ', l.source, l.relation, l.target) = m.subject and l.producer = m.producer),
y as (select *, case when nothing then 'new' when le < {FROM} then 'unknown_baseline' when lk = 'delete' and st <= le then 'dropped' when lk = 'delete' then 'new' when ll <= st then 'new' when least(ll, obs) < {FROM} then 'unknown_below_horizon' when coalesce(payload, '') = coalesce(lp, '') then 'raised' when lt > 0 and obs > ll + lt then 'changed_gap' else 'changed' end decision from x),
z as (select *, decision like 'unknown%' or decision like 'changed%' fo, case when decision = 'dropped' then null when decision like 'unknown%' or decision like 'changed%' then obs when decision = 'raised' then least(ll, obs) else st end own,
 case when decision like 'unknown%' or decision like 'changed%' then 2 when decision = 'raised' then 2 else 1 end b from y),
w as (select *, max(own) over (partition by subject, producer order by place rows between unbounded preceding and current row) top from z),
v as (select w.*, (select max(q.b) from w q where q.subject = w.subject and q.producer = w.producer and q.place <= w.place and q.own = w.top) tb from w)
select seq, decision, greatest(own, top) event_time_ns, case when not fo and obs > greatest(own, top) then obs end through_ns, cast(case when top > own then tb else b end as int) event_time_basis from v"""
_POINTS = f"p as (select 's' || user_id series, ns // {10 * DAY} st, ns t, event_id % 4 v from events, lateral (select epoch_ns(ts) ns) where event_id % 10 > 0), q as (select *, row_number() over (partition by series order by t, st) i from p)"
_STEP = f"""case when n.t - k.lt > {DAY} then {{fresh}} when n.t <= k.lt or n.st < k.st then {{same}} when n.st = k.st and n.v > k.v then {{up}} when n.st > k.st or n.v < k.v or n.t - k.up > {DAY // 4} then case when n.v > 0 then {{up}} else {{flat}} end else {{flat}} end"""
_PODS = f"""o as (select 'u' || user_id uid, ns, event_id, event_type = 'error' del, user_id, cast(json_extract_string(props, '$.k') as bigint) % 25 n from {{ev}}),
g as (select *, coalesce(max(del::int) over (partition by uid order by ns, event_id rows between unbounded preceding and 1 preceding), 0) gone, row_number() over (partition by uid order by ns, event_id) k from o), u as (select * from g where gone = 0)"""
_OBJ = f"with {_EV}, " + _PODS.format(ev="e")
ORACLE = {
    "sm2_partial_success": "select event_id, not bool_or(user_id % 50 = 0) over (partition by event_id // 10) accepted from events",
    "sm3_refused_requests": "select event_id // 100 request, count(*) records, bool_or(user_id = 7) refused from events group by 1",
    "sm4_routes": f"select {_ROUTE} route, count(*) n from events group by 1",
    "sm6_flushed": f"""select subject, producer, "start" event_time_ns, "last" through_ns, ttl ttl_ns from ({_RUNS}) where kind = 'observe' and ttl > 0 and "last" > stored and stored + ttl <= {T + 60 * 10**9}""",
    "sm7_prunable": f"""select subject, producer, "start" from ({_RUNS}) where kind = 'observe' and ttl > 0 and "last" + ttl < {T} and not ("last" > stored and "last" >= {FROM})""",
    "sm8_extension": f"with {_A} select distinct ttl_ns, ttl_ns // 2 extension_ns from a where ttl_ns > 0",
    "sm9_resumed": _RESUME,
    "sm10_counter_sightings": f"""with recursive {_POINTS}, kf(series, i, st, v, lt, up, seen) as (select series, i, st, v, t, t, t >= {FROM} and v > 0 from q where i = 1 union all
select n.series, n.i, {_STEP.format(fresh='n.st', same='k.st', up='n.st', flat='n.st')}, {_STEP.format(fresh='n.v', same='k.v', up='n.v', flat='n.v')}, {_STEP.format(fresh='n.t', same='k.lt', up='n.t', flat='n.t')},
 {_STEP.format(fresh='n.t', same='k.up', up='n.t', flat='k.up')}, {_STEP.format(fresh=f'(n.t >= {FROM} and n.v > 0)', same='false', up='true', flat='false')} from kf k join q n on n.series = k.series and n.i = k.i + 1)
select kf.series, q.t time_ns from kf join q on q.series = kf.series and q.i = kf.i where seen union all select 's' || user_id, epoch_ns(ts) from events where event_id % 10 = 0 and event_id % 4 > 0""",
    "sm10_call_fates": f"""with {_EV} select case when event_id % 5 = 0 then 'database' when event_id % 7 = 0 then 'no connection type' when event_id % 11 = 0 then 'virtual node label' when user_id % 9 = 0 then 'no service name' else 'used' end fate, count(*) n from e group by 1""",
    "sm12_span_sightings": f"""with {_EV}, g as (select 'svc' || (user_id % 5) n, 'i' || user_id i, case when user_id % 3 > 0 then 'p' || user_id end p, max(ns) t from e where event_id % 6 > 0 and event_id % 3 > 0 and user_id % 13 > 0 group by all)
select t event_time_ns, 'L3' layer, 'service:' || n || '/' source, null target, null relation, {HOUR} ttl_ns, '{{"name":"' || n || '"}}' payload from g
union all select t, 'L2', 'service.instance:' || i || '/' || n || '/', null, null, {HOUR}, '{{"service.version":"1"}}' from g
union all select t, 'L2', 'service.instance:' || i || '/' || n || '/', 'service:' || n || '/', 'instance_of', {HOUR}, null from g
union all select t, 'L2', 'service.instance:' || i || '/' || n || '/', 'k8s.pod:' || p, 'part_of', {HOUR}, null from g where p is not null""",
    "sm12_span_fates": "select case when event_id % 6 = 0 then 'not a delta' when event_id % 3 = 0 then 'no spans' when user_id % 13 = 0 then 'no instance id' else 'sighting' end fate, count(*) n from events group by 1",
    "sm13_object_records": _OBJ + f""" select case when k = 1 and not del then {CREATED} else ns end event_time_ns, 'k8s.pod:' || uid source, case when del then 'delete' else 'observe' end kind, case when del then 0 else {30 * DAY} end ttl_ns, case when k = 1 and not del then ns end through_ns, case when k = 1 and not del then 1 else 2 end event_time_basis from u
union all select {CREATED}, 'k8s.node:nu' || n_nationkey, 'observe', {30 * DAY}, {fixtures.JANUARY_NS}, 1 from nation""",
    "sm13_object_fates": _OBJ + " select case when gone = 1 then 'after delete' else 'used' end fate, count(*) + max(case when gone = 0 then (select count(*) from nation) else 0 end) n from g group by 1",
    "sm14_event_times": _OBJ + """, c as (select case when k = 1 then """ + str(CREATED) + """ else ns end t, 'container:b' || user_id s, 'k8s.pod:' || uid p, case when k = 1 then ns end th from u where not del),
x as (select ns t, 'container:b' || user_id s, 'k8s.pod:' || uid p from u where del and k > 1)
select distinct t event_time_ns, s source, null target, 'observe' kind, th through_ns from c union all select distinct t, s, p, 'observe', th from c union all select distinct t, s, null, 'delete', null from x union all select distinct t, s, p, 'delete', null from x""",
    "sm15_pending": _OBJ + f""", f as (select uid, n, min(case when k = 1 then {CREATED} else ns end) b from u where not del group by 1, 2),
i as (select case when n_nationkey = 24 then 3 else n_nationkey end n, n_nationkey nu, {CREATED} s, {fixtures.JANUARY_NS + 30 * DAY} e from nation), r as (select f.*, (select count(distinct nu) from i where i.n = f.n and s <= f.b and f.b < e) c from f)
select uid, 'n' || n node_name, b begin_ns, case when c > 1 then 'ambiguous' else 'unknown' end reason from r where c <> 1""",
    "sm16_cluster_records": _OBJ + f""", h as (select u.*, e2.event_type from u join events e2 on e2.event_id = u.event_id)
select distinct case when k = 1 and not del then {CREATED} else ns end event_time_ns, 'k8s.pod:' || uid source, case when del then 'delete' else 'observe' end kind, case when del then 0 else {900 * 10**9} end ttl_ns, case when k = 1 and not del then ns end through_ns,
 case when not del then '{{"k8s.pod.name":"pod' || user_id || '","k8s.pod.phase":"' || event_type || '","pod.creation_timestamp":"2023-12-31T00:00:00Z"}}' end payload, case when k = 1 and not del then 1 else 4 end event_time_basis from h""",
    "sm17_host_records": f"""with {_EV}, h as (select ns, 'host:h' || (user_id % 10) h, case when user_id % 4 > 0 then 'k8s.node:n' || user_id end n, case when user_id % 2 > 0 then 'topo.zone:x/y/z' end z, '{{' || case when user_id % 2 > 0 then '"cloud.availability_zone":"z",' else '' end || '"cloud.provider":"x","cloud.region":"y","host.arch":"amd64"}}' p from e where event_type <> 'error' and user_id % 10 > 0)
select ns event_time_ns, 'L1' layer, h source, null target, null relation, {15 * MINUTE} ttl_ns, p payload, 'b1' boot from h union all select ns, 'L1', n, h, 'runs_on', {15 * MINUTE}, null, null from h where n is not null
union all select ns, 'L1', z, null, null, {15 * MINUTE}, null, null from h where z is not null union all select ns, 'L1', h, z, 'located_in', {15 * MINUTE}, null, null from h where z is not null""",
    "sm18_address_claims": _OBJ + f""", r as (select uid, user_id, ns, del, k from u), l as (select *, row_number() over (partition by uid order by ns, k) j from r)
select distinct ns event_time_ns, 'k8s.pod:' || uid source, 'topo.endpoint:10.0.' || (user_id % 4) || '.1/k8s/c' target, 'observe' kind from l where not del
union all select distinct ns, 'k8s.pod:' || uid, 'topo.endpoint:10.0.' || (user_id % 4) || '.1/k8s/c', 'delete' from l where del and j > 1
union all select {fixtures.JANUARY_NS}, 'k8s.node:nu' || n_nationkey, 'topo.endpoint:192.168.0.' || n_nationkey || '/k8s/c', 'observe' from nation""",
    "sm18_claimed_twice": _OBJ + f""", h as (select '10.0.' || (user_id % 4) || '.1' address, uid holder, ns "start", least(coalesce(lead(ns) over (partition by uid order by ns, event_id), ns + {30 * DAY}), ns + {30 * DAY}) "end", del from u),
sp as (select address, holder, "start", "end" from h where not del and "start" < "end"), """ + _several("av", "sp", "address", "holder") + """ select address, min("start") "first" from av group by 1""",
    "sm19_shared_names": f"""with {_EV}, g as (select 'c' || (user_id % 20) c, cast(user_id % 3 as varchar) u, arg_max(event_type = 'error', (ns, event_type = 'error')) del, max(ns) t from e where ns <= {T} group by all), al as (select * from g where not del and t + {DAY} > {T})
select 'refused' what, c "key", count(distinct u) n from al group by c having count(distinct u) > 1 union all select 'noted', u, count(distinct c) from al group by u having count(distinct c) > 1""",
    "sm21_newest_of_others": f"with {_A} select max(event_time_ns) newest_ns from a where producer <> 'p1'",
    "sm22_pull_gaps": f"""with {_EV}, g as (select distinct event_type, ns "at" from e), l as (select *, "at" - lag("at") over (partition by event_type order by "at") gap from g) select * from l where gap * 2 > {HOUR}""",
    "sm23_silent": f"""with {_EV} select user_id, max(ns) "last" from e where ns < {T} group by 1 having {T} - max(ns) > {3 * HOUR}""",
    "sm24_fates": """select case when event_type = 'signup' then 'legacy entity event' when event_type = 'purchase' then 'not an entity event' when event_type = 'view' then 'not a host' when event_type = 'error' then 'host delete' when user_id % 2 = 0 then 'no host id' else 'host' end fate, count(*) n from events group by 1""",
    "sm1_committed": f"with {_A} select count(*) records, 1 \"first\", count(*) \"last\", count(*) seqs from a",
}
