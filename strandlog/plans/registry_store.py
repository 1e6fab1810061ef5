"""Registered queries over the log's storage: sources, sinks, horizons, checkpoints; and their SQL for DuckDB."""

from __future__ import annotations



from pyspark.sql import functions as F

from strandlog import cli, schema
from strandlog.operators import checkpoints, log as reads
from strandlog.operators.order import numbered
from strandlog.plans.registry import FROM, T, TO, TOKEN, _A, _B, _latest, _live, _SEEN
from strandlog.schema import OPEN
from strandlog.sources import activity, capture, demo, fixtures, segments, store, trace
from strandlog.staging import new_path, staged

MIDDLE = 9000  #: a seq in the midst of the placements


def sc1_checked_groups(s, d):
    """The placements written, read back, and compared with the digests written beside them."""
    path = new_path(s, "activity")
    activity.write(fixtures.placements(s, d), path)
    return activity.checked(s, path)


def sc2_round_trip(s, d):
    log, path = fixtures.placements(s, d), new_path(s, "activity")
    activity.write(log, path)
    return activity.read(s, f"{path}/records").select("seq", "event_time_ns", "layer", "source", "target", "kind", "ttl_ns", "through_ns", F.decode("payload", "UTF-8").alias("payload"))


def sc2_round_trip_differences(s, d):
    log, path = fixtures.placements(s, d), new_path(s, "activity")
    activity.write(log, path)
    return activity.differences(log, activity.read(s, f"{path}/records"))


def sc3_group_digests(s, d):
    return activity.group_digests(fixtures.placements(s, d)).select("group", "records", "digest")


def _events(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.withColumn("ns", F.expr(fixtures.NS.format("ts")))


def _captured(s, d):
    """Events as log records, fifty to a request, written as JSON lines and read back."""
    e = _events(s, d)
    sequence = F.when(F.col("event_id") % 3 > 0, F.col("event_id").cast("string"))
    attrs = F.map_filter(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("sequence"), sequence), lambda k, v: v.isNotNull())
    records = e.select(
        F.floor(F.col("event_id") / 50).alias("request"), F.col("event_type").alias("event_name"), F.col("ns").alias("time_ns"), (F.col("ns") + 1000 * (F.col("event_id") % 5)).alias("observed_ns"),
        F.create_map(F.lit("cluster"), F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string"))).alias("resource"), attrs.alias("attrs"), F.col("props").alias("body"),
    )
    path = new_path(s, "capture")
    capture.log_lines(records).write.text(path)
    return capture.log_records(capture.read_lines(s, path))


def sc4_capture_logs(s, d):
    r = _captured(s, d)
    return r.select("event_name", "time_ns", "observed_ns", F.col("resource")["cluster"].alias("cluster"), F.col("attrs")["user"].alias("user"), "body")


def sc5_capture_order(s, d):
    """Places of the records: those with a sequence by it, then the others by observation; ties are equal in all that is shown."""
    return capture.in_order(_captured(s, d)).select("place", F.col("attrs")["sequence"].alias("sequence"), "observed_ns", "time_ns", "event_name")


def sc7_metric_points(s, d):
    e = _events(s, d)
    points = e.select(
        F.floor(F.col("event_id") / 50).alias("request"), F.lit("calls").alias("metric"), F.when(F.col("event_id") % 2 == 0, "delta").otherwise("cumulative").alias("temporality"),
        F.lit(FROM).alias("start_ns"), F.col("ns").alias("time_ns"), F.col("user_id").cast("double").alias("value"), F.create_map(F.lit("type"), F.col("event_type")).alias("attrs"),
    )
    path = new_path(s, "metrics")
    capture.metric_lines(points).write.text(path)
    return capture.metric_points(capture.read_lines(s, path)).select("metric", "temporality", "start_ns", "time_ns", "value", F.col("attrs")["type"].alias("type"))


def sc9_store_window(s, d):
    """Edge records of one layer and a window, read from the layout: other layers and times are not opened."""
    log = fixtures.placements(s, d)
    return log.filter((F.col("layer") == "L2") & (F.col("subject_kind") == "edge") & (F.col("event_time_ns") >= FROM) & (F.col("event_time_ns") < TO)).select("seq", "source", "target", "event_time_ns")


def sc10_append(s, d):
    log = fixtures.placements(s, d).drop("payload").withColumn("payload", F.lit(None).cast("binary")).withColumn("boot", F.lit(None).cast("string"))
    return reads.append(log.filter(F.col("seq") <= MIDDLE), log.filter(F.col("seq") > MIDDLE)).select("seq", "source")


def sc11_segments(s, d):
    held = segments.Segments(s, new_path(s, "segments"))
    for row in s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").collect():  # a fixed table of 25 rows
        held.put(f"n/{row[0]:03d}.seg", row[1].encode())
    held.delete("n/003.seg")
    return held.list("n/", "n/001.seg")


def _cut_twice(s, d):
    log, path = fixtures.placements(s, d), new_path(s, "backup")
    last = reads.last_seq(log)
    activity.cut(log, path, 0, MIDDLE, 1)
    activity.cut(log, path, MIDDLE, last, 2)
    return path


def sc13_backup_manifests(s, d):
    return activity.manifests(s, _cut_twice(s, d)).filter("class is not null").select("generation", "class", "records", "min_seq", "max_seq")


def sc15_restore(s, d):
    return activity.restore(s, _cut_twice(s, d)).select("seq", "event_time_ns", "source", "target", "kind", F.decode("payload", "UTF-8").alias("payload"))


def sc17_replay(s, d):
    """A replay that is broken off after a part and goes on from the last whole batch."""
    log, path = fixtures.placements(s, d), new_path(s, "replay")
    activity.replay(log.filter(F.col("seq") <= MIDDLE), path, 2000)
    activity.replay(log, path, 2000, MIDDLE // 2000 * 2000)
    return activity.read(s, path).select("seq", "source", "target")


def sc18_demo_world(s, d):
    return demo.world(s)


def _trace_lines(s, d):
    """Lines of a trace made of events and orders, some of them with faults."""
    e = _events(s, d)
    ms = F.floor((F.col("ns") - FROM + 10**15) / 1_000_000).cast("string")
    broken = F.when(F.col("event_id") % 41 == 0, F.lit("x")).otherwise(ms)
    node = F.when(F.col("event_id") % 37 == 0, F.lit(" ")).otherwise(F.concat(F.lit("n"), (F.col("event_id") % 25).cast("string")))
    parts = [broken, F.lit("svc"), F.concat(F.lit("i"), F.col("user_id").cast("string")), node, F.lit("0.5")]
    placed = e.select(F.when(F.col("event_id") % 53 == 0, F.concat_ws(",", *parts)).otherwise(F.concat_ws(",", *parts, F.lit("0.1"))).alias("value"))
    up = F.when(F.col("event_id") % 29 == 0, F.lit("UNKNOWN")).otherwise(F.concat(F.lit("s"), (F.col("event_id") % 9).cast("string")))
    kind = F.when(F.col("event_id") % 31 == 0, F.lit("0.0.0")).otherwise(F.lit("rpc"))
    called = e.select(F.concat_ws(",", ms, F.lit("t"), F.lit("0.1"), F.lit("u"), kind, up, F.lit("ui"), F.lit("x"), F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string")), F.lit("di"), F.lit("12")).alias("value"))
    return placed, called


def sc20_trace_fates(s, d):
    placed, called = _trace_lines(s, d)
    a = trace.placements(placed).groupBy("fate").count().withColumn("file", F.lit("placement"))
    return a.unionByName(trace.calls(called).groupBy("fate").count().withColumn("file", F.lit("calls"))).select("file", "fate", F.col("count").alias("n"))


def sc20_trace_records(s, d):
    placed, called = _trace_lines(s, d)
    return trace.reduced(trace.placements(placed), trace.calls(called), epoch_ns=FROM).select("event_time_ns", "layer", "source", "target", "relation")


def sc21_archive(s, d):
    """The archive by subject, read back: first and last seq of each."""
    path = new_path(s, "archive")
    activity.archive(fixtures.placements(s, d), path)
    back = s.read.parquet(path).withColumn("subject", schema.subject_key())
    return back.groupBy("layer", "subject").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("records"))


def st2_tokens(s, d):
    log = fixtures.placements(s, d)
    asked = [1, TOKEN, 10**12]
    return s.createDataFrame([(a, reads.resolve_token(log, a)) for a in asked] + [(None, reads.resolve_token(log))], "asked long, token long")


def st3_last_seq(s, d):
    return fixtures.placements(s, d).groupBy("layer").agg(F.max("seq").alias("last_seq"))


def st8_entity_window(s, d):
    return reads.window(fixtures.placements(s, d), FROM, TO, "entity").select("seq", "source", "event_time_ns", "kind")


def st11_bounded_search(s, d):
    log = fixtures.placements(s, d).drop("payload")
    refs = log.select(schema.subject_key().alias("subject"), "producer").distinct()
    return reads.last_assertion(log, refs, {"L2": FROM}, bound=4).select("subject", "producer", "outcome", "seq")


def st12_refused_reads(s, d):
    """Reads at the time and with the knowledge of every event, against the horizons of a reference horizon."""
    log = fixtures.placements(s, d)
    horizons = reads.horizons_at(log.filter(F.col("seq") <= TOKEN), FROM)
    asked = log.select("layer", F.col("event_time_ns").alias("from_ns"), F.col("seq").alias("token"))
    return reads.refused(asked, horizons)


def st13_horizons(s, d):
    log = fixtures.placements(s, d)
    first = reads.horizons_at(log.filter(F.col("seq") <= TOKEN), FROM)
    back = reads.horizons_at(log, FROM - 10**15)
    return reads.advanced(reads.advanced(first, back), reads.horizons_at(log.filter(F.col("seq") <= MIDDLE), TO))


def st14_window_lines(s, d):
    return cli.lines(cli.window(fixtures.placements(s, d), FROM, TO, "edge"))


def st15_edge_layers(s, d):
    return schema.edge_layers_of_types(s)


def rt2_boot_state(s, d):
    return checkpoints.boot_state(fixtures.boots(s, d), TO)


def rt2_quarantine_from_state(s, d):
    log = fixtures.boots(s, d)
    return checkpoints.quarantined(checkpoints.boot_state(log, FROM), log, FROM)


def rt4_checkpoint_seeds(s, d):
    """Seeds of a window by way of a checkpoint five days before it, built when two thirds of the records had arrived."""
    log = fixtures.placements(s, d)
    points = staged(checkpoints.checkpoint(log, FROM - 432_000_000_000_000, 2 * MIDDLE // 3), "checkpoints")
    return checkpoints.window_since(log, points, FROM, TO, reads.last_seq(log)).select("seq", "part")


def ag11_layer_sizes(s, d):
    return store.layer_sizes(fixtures.placements(s, d))


def sm1_numbered(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "event_type")
    return numbered(e, ["ts", "event_id"], after=1000).select("event_id", "seq")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and not k.startswith("_") and k[:2] in ("sc", "st", "rt", "ag", "sm") and getattr(f, "__module__", "") == __name__}


def _number(x: str, size: int = 8) -> str:
    return f"format('{{:0{2 * size}x}}', {x})"


def _text(x: str) -> str:
    raw = f"encode(coalesce({x}, ''))"
    return f"format('{{:08x}}', octet_length({raw})) || hex({raw})"


_HEX = " || ".join([
    _number("seq"), _number("event_time_ns"), *[_text(c) for c in ("layer", "subject_kind", "source", "target", "relation", "producer", "kind")], _number("ttl_ns"),
    "case when through_ns is null then '00' else '01' end", _number("coalesce(through_ns, 0)"), _text("payload"), "'00'", "'00000000'", "'00000000'",
])
_GROUPS = f"""with {_A}, h as (select seq, {_HEX} hex, (row_number() over (order by seq) - 1) // 1000 g from a)
select g "group", count(*) records, min(seq) first_seq, max(seq) last_seq, sha256(from_hex(string_agg(hex, '' order by seq))) digest from h group by g"""
_EV = "e as (select *, epoch_ns(ts) ns from events)"
_MS = f"cast((ns - {FROM} + 1000000000000000) // 1000000 as varchar)"
_TRACE = f"""with {_EV}, p as (select case when event_id % 53 = 0 then 'columns' when event_id % 41 = 0 then 'timestamp' when event_id % 37 = 0 then 'empty_id' else 'used' end fate,
  (ns - {FROM} + 1000000000000000) // 1000000 // 60000 m, user_id u, event_id % 25 n from e),
c as (select case when event_id % 31 = 0 then 'shifted' when event_id % 29 = 0 then 'unknown_endpoint' else 'used' end fate, (ns - {FROM} + 1000000000000000) // 1000000 // 60000 m, event_id % 9 x, user_id % 9 y from e)"""
_LIMITS = f"h as (select 'L1' layer, {{at}} - 5184000000000000 time_ns union all select 'L2', {{at}} union all select 'L3', {{at}})"
_NOT_LATE = f"row_number() over (partition by layer, source order by event_time_ns desc, seq desc)"

ORACLE = {
    "sc1_checked_groups": f"select *, true ok from ({_GROUPS})",
    "sc2_round_trip": f"with {_A} select seq, event_time_ns, layer, source, target, kind, ttl_ns, through_ns, payload from a",
    "sc2_round_trip_differences": "select 'first' side, 0 records union all select 'second', 0",
    "sc3_group_digests": f'select "group", records, digest from ({_GROUPS})',
    "sc4_capture_logs": f"""with {_EV} select event_type event_name, ns time_ns, ns + 1000 * (event_id % 5) observed_ns, 'c' || (event_id % 2) cluster, cast(user_id as varchar) "user", props body from e""",
    "sc5_capture_order": f"""with {_EV}, r as (select case when event_id % 3 > 0 then event_id end q, ns + 1000 * (event_id % 5) observed_ns, ns time_ns, event_type event_name from e)
select row_number() over (order by q nulls last, observed_ns, time_ns, event_name) place, cast(q as varchar) "sequence", observed_ns, time_ns, event_name from r""",
    "sc7_metric_points": f"""with {_EV} select 'calls' metric, case when event_id % 2 = 0 then 'delta' else 'cumulative' end temporality, {FROM} start_ns, ns time_ns, user_id::double "value", event_type "type" from e""",
    "sc9_store_window": f"with {_A} select seq, source, target, event_time_ns from a where layer = 'L2' and subject_kind = 'edge' and event_time_ns >= {FROM} and event_time_ns < {TO}",
    "sc10_append": f"with {_A} select seq, source from a",
    "sc11_segments": "select format('n/{:03d}.seg', n_nationkey) \"name\", octet_length(encode(n_name)) bytes from nation where n_nationkey > 1 and n_nationkey <> 3",
    "sc13_backup_manifests": f"""with {_A} select case when seq <= {MIDDLE} then 1 else 2 end generation, case when subject_kind = 'entity' and source like 'host:%' then 'hosts' else lower(layer) end "class", count(*) records, min(seq) min_seq, max(seq) max_seq from a group by 1, 2""",
    "sc15_restore": f"with {_A} select seq, event_time_ns, source, target, kind, payload from a",
    "sc17_replay": f"with {_A} select seq, source, target from a",
    "sc18_demo_world": demo.text(lambda n: f"(select range id from range({n}))", lambda x: f"cast('0x' || substr(md5({x}), 1, 7) as bigint)", ", lateral (select unnest(range(0, cast(p.life // {beat} + 1 as bigint))) beat) x"),
    "sc20_trace_fates": _TRACE + " select 'placement' file, fate, count(*) n from p group by fate union all select 'calls', fate, count(*) from c group by fate",
    "sc20_trace_records": _TRACE + f""", w as (select distinct m, u, n from p where fate = 'used'), k as (select distinct m, x, y from c where fate = 'used')
select distinct m * 60000000000 + {FROM} event_time_ns, layer, source, target, relation from (
 select m, 'L2' layer, 'k8s.pod:i' || u source, null target, null relation from w union all select m, 'L2', 'k8s.node:n' || n, null, null from w union all select m, 'L2', 'k8s.pod:i' || u, 'k8s.node:n' || n, 'scheduled_on' from w
 union all select m, 'L3', 'service:s' || x, null, null from k union all select m, 'L3', 'service:s' || y, null, null from k union all select m, 'L3', 'service:s' || x, 'service:s' || y, 'depends_on' from k)""",
    "sc21_archive": f"with {_A} select layer, concat_ws(' ', source, relation, target) subject, min(seq) first_seq, max(seq) last_seq, count(*) records from a group by 1, 2",
    "st2_tokens": f"with {_A}, l as (select max(seq) top from a) select x asked, least(coalesce(x, top), top) token from l, (values (1), ({TOKEN}), (1000000000000), (null)) v(x)",
    "st3_last_seq": f"with {_A} select layer, max(seq) last_seq from a group by layer",
    "st8_entity_window": f"with {_A} select seq, source, event_time_ns, kind from a where subject_kind = 'entity' and event_time_ns >= {FROM} and event_time_ns < {TO}",
    "st11_bounded_search": f"""with {_A}, p as (select *, {_NOT_LATE} place from a), {_latest("le", "p", OPEN)}
select concat_ws(' ', source, relation, target) subject, producer, case when place > 4 then 'exhausted' when layer = 'L2' and event_time_ns < {FROM} then 'baseline_only' else 'found' end outcome, case when place <= 4 then seq end seq from le""",
    "st12_refused_reads": f"""with {_A}, {_LIMITS.format(at=FROM)}, l as (select max(seq) top from a where seq <= {TOKEN})
select a.layer, event_time_ns from_ns, seq token, coalesce(event_time_ns < time_ns or seq < top, false) refused from a cross join l left join h on h.layer = a.layer""",
    "st13_horizons": f"with {_A}, {_LIMITS.format(at=TO)} select layer, time_ns, (select max(seq) from a) seq from h",
    "st14_window_lines": f"""with {_A} select to_json(struct_pack(seq := seq, event_time_ns := event_time_ns, source := source, target := target, relation := relation, producer := producer, kind := kind, ttl_ns := ttl_ns)) line from a where subject_kind = 'edge' and event_time_ns >= {FROM} and event_time_ns < {TO}""",
    "st15_edge_layers": """with r(f, t, l) as (values ('container', 'k8s.pod', 'L2'), ('service.instance', 'k8s.pod', 'L2'), ('k8s.pod', 'k8s.node', 'L2'), ('k8s.node', 'host', 'L1'), ('process', 'host', 'L1'), ('host', 'topo.rack', 'L1'), ('host', 'topo.zone', 'L1'),
 ('service.instance', 'service', 'L2'), ('service', 'service', 'L3'), ('k8s.pod', 'topo.endpoint', 'L2'), ('k8s.node', 'topo.endpoint', 'L2'))
select distinct f "type", 'forward' direction, l layer from r union select distinct t, 'reverse', l from r""",
    "rt2_boot_state": f"""with {_B.replace("from events where event_type='signup'", "from events where event_type='signup' and epoch_ns(ts) < " + str(TO))}{_SEEN}, nw as (select *, lead(first_seen) over (partition by source order by first_seen, boot) newer from bt),
co as (select sn.source, sn.boot, min(sn."at") collided_at from sn join nw on sn.source = nw.source and sn.boot = nw.boot where sn."at" > newer group by 1, 2)
select nw.source, nw.boot, first_seen, last_seen, newer, collided_at from nw left join co on co.source = nw.source and co.boot = nw.boot""",
    "rt2_quarantine_from_state": f"""with {_B}{_SEEN}, nw as (select *, lead(first_seen) over (partition by source order by first_seen, boot) newer from bt)
select distinct sn.source from sn join nw on sn.source = nw.source and sn.boot = nw.boot where sn."at" > newer""",
    "rt4_checkpoint_seeds": f"with {_A}, " + _latest("le", "a", FROM - 1) + f" select seq, 'seed' part from le where {_live(FROM - 1)} union all select seq, 'window' from a where event_time_ns >= {FROM} and event_time_ns < {TO}",
    "ag11_layer_sizes": f"""with {_A} select layer, subject_kind, count(*) records, cast(sum(octet_length(encode(coalesce(payload, '')))) as bigint) payload_bytes,
 cast(sum(octet_length(encode(source)) + octet_length(encode(coalesce(target, ''))) + octet_length(encode(coalesce(relation, ''))) + octet_length(encode(producer))) as bigint) key_bytes from a group by 1, 2""",
    "sm1_numbered": "select event_id, 1000 + row_number() over (order by ts, event_id) seq from events",
}
