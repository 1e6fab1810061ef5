"""Ingest on small cases: what each rule writes, and streams against their batches."""

import json

import pytest
from pyspark.sql import functions as F

from strandlog.plans.registry_ingest import plain
from strandlog.streaming import coalescer, operate, resume, translate

S = 1_000_000_000
T0 = 1_704_067_200 * S  # 2024-01-01


def at(seconds):
    return f"2024-01-01T00:{seconds // 60:02d}:{seconds % 60:02d}Z"


def pod(uid, node=None, phase="Running", ips=(), boxes=(), created=0, scheduled=None, **more):
    conditions = [{"type": "PodScheduled", "status": "True", "lastTransitionTime": at(scheduled)}] if scheduled is not None else []
    return {"kind": "Pod", "metadata": {"uid": uid, "name": f"n-{uid}", "creationTimestamp": at(created)}, "spec": {"nodeName": node, **more}, "status": {"phase": phase, "podIPs": [{"ip": i} for i in ips], "conditions": conditions, "containerStatuses": [{"name": b, "containerID": f"run://{b}"} for b in boxes]}}


def node(uid, name, created=0, address=None):
    return {"kind": "Node", "metadata": {"uid": uid, "name": name, "creationTimestamp": at(created)}, "status": {"addresses": [{"type": "InternalIP", "address": address}] if address else []}}


def translated(spark, rows, ttl=100 * S):
    """rows: (observed second, watch type or None, object)"""
    lines = [(T0 + t * S, k, json.dumps({"type": w, "object": o} if w else o)) for k, (t, w, o) in enumerate(rows)]
    records = spark.createDataFrame(lines, "observed_ns long, place long, body string")
    out = translate.objects(records, "c", ttl, plain).collect()
    brief = {((r.event_time_ns - T0) // S, r.source.split(":", 1)[1], r.target and r.target.split(":", 1)[1], r.relation, r.kind, r.through_ns and (r.through_ns - T0) // S) for r in out}
    return brief, records


def test_objects_times_edges_and_ends(spark):
    got, _ = translated(spark, [(10, None, node("N", "n1")), (20, None, pod("P", "n1", boxes=["b"], created=2, scheduled=3)), (30, "MODIFIED", pod("P", "n1", "Failed", boxes=["b"], created=2, scheduled=3)), (40, "DELETED", pod("P", "n1", created=2)), (50, None, pod("P", "n1", created=2))])
    assert {g for g in got if g[1] == "P" and g[3] is None} == {(2, "P", None, None, "observe", 20), (30, "P", None, None, "observe", None), (40, "P", None, None, "delete", None)}
    assert {g for g in got if g[3] == "scheduled_on"} == {(3, "P", "N", "scheduled_on", "observe", 20), (30, "P", "N", "scheduled_on", "observe", None), (40, "P", "N", "scheduled_on", "delete", None)}
    assert {g for g in got if g[3] == "part_of"} == {(2, "b", "P", "part_of", "observe", 20), (30, "b", "P", "part_of", "observe", None), (40, "b", "P", "part_of", "delete", None)}


def test_node_names_and_pending(spark):
    rows = [(10, None, node("N", "n1", created=5)), (11, None, node("M", "n2", created=5)), (12, None, node("K", "n2", created=5)), (20, None, pod("A", "n1", scheduled=2)), (21, None, pod("B", "n2", scheduled=8)), (22, None, pod("C", "n1", scheduled=9))]
    got, records = translated(spark, rows)
    assert {g[1] for g in got if g[3] == "scheduled_on"} == {"C"}
    timed = translate.timed(translate.watched(records).filter("read = 'used'").drop("read"))
    assert {(r.uid, r.reason) for r in translate.pending(timed, 100 * S).collect()} == {("A", "unknown"), ("B", "ambiguous")}


def test_addresses(spark):
    rows = [(10, None, node("N", "n1", address="10.0.0.1")), (20, None, pod("A", ips=["10.0.0.9", "fe80::1"])), (30, None, pod("A", ips=["8.8.8.8"])), (40, None, pod("B", ips=["8.8.8.8"])), (50, None, pod("A", phase="Succeeded", ips=["8.8.8.8"])), (60, None, pod("H", ips=["10.0.0.1"], hostNetwork=True))]
    got, records = translated(spark, rows)
    assert {g for g in got if g[3] == "has_address"} == {
        (10, "N", "10.0.0.1/k8s/c", "has_address", "observe", None), (20, "A", "10.0.0.9/k8s/c", "has_address", "observe", None), (30, "A", "10.0.0.9/k8s/c", "has_address", "delete", None),
        (30, "A", "8.8.8.8/global", "has_address", "observe", None), (40, "B", "8.8.8.8/global", "has_address", "observe", None), (50, "A", "8.8.8.8/global", "has_address", "delete", None)}
    timed = translate.timed(translate.watched(records).filter("read = 'used'").drop("read"))
    assert [(r.address, (r.start - T0) // S, (r.end - T0) // S) for r in translate.claimed_twice(timed, "c", 100 * S).collect()] == [("8.8.8.8", 40, 50)]


def test_times_are_clamped_and_plausible(spark):
    got, _ = translated(spark, [(100, None, pod("P", created=2000)), (200, "MODIFIED", pod("P", phase="X", created=2, scheduled=50)), (210, "MODIFIED", pod("P", phase="Y", created=2, scheduled=205))])
    assert {g for g in got if g[1] == "P"} == {(100, "P", None, None, "observe", None), (100, "P", None, None, "observe", 200), (205, "P", None, None, "observe", 210)}  # the second change alone tells when it happened


def test_resume_decides(spark):
    cols = "seq long, event_time_ns long, layer string, subject_kind string, source string, target string, relation string, producer string, kind string, ttl_ns long, through_ns long, payload binary, event_time_basis int"
    row = lambda seq, t, s, kind="observe", through=None, payload=b"x", ttl=10: (seq, t, "L2", "entity", s, None, None, "p", kind, 0 if kind == "delete" else ttl, through, None if kind == "delete" else payload, 4)
    stored = spark.createDataFrame([row(1, 50, "k8s.pod:same"), row(2, 50, "k8s.pod:other", payload=b"y"), row(3, 50, "k8s.pod:gone", "delete"), row(4, 5, "k8s.pod:early"), row(5, 50, "k8s.pod:run", through=70), row(6, 20, "k8s.pod:base"), row(7, 95, "k8s.pod:ahead"), row(8, 8, "k8s.pod:dead", "delete")], cols)
    marked = spark.createDataFrame([(100 + k, row(100 + k, 10, f"k8s.pod:{s}", through=80)) for k, s in enumerate(["same", "other", "gone", "early", "run", "new", "ahead", "dead"])], f"place long, r struct<{cols.replace(' ', ':').replace(',:', ',')}>").select("place", "r.*")
    got = {r.source.split(":")[1]: (r.decision, r.event_time_ns, r.through_ns, r.event_time_basis) for r in resume.decided(marked, stored).collect()}
    assert got["same"] == ("raised", 50, 80, 4) and got["other"] == ("changed_gap", 80, None, 2) and got["gone"][0] == "dropped" and got["early"] == ("new", 10, 80, 4)
    assert got["run"] == ("raised", 70, 80, 2) and got["new"] == ("new", 10, 80, 4) and got["ahead"] == ("raised", 80, None, 2) and got["dead"] == ("new", 10, 80, 4)
    low = {r.source.split(":")[1]: r.decision for r in resume.decided(marked, stored, {"L2": 60}).collect()}
    assert low["same"] == "unknown_baseline" and low["ahead"] == "raised"


def test_run_steps():
    r = lambda t, payload="x", kind="observe", ttl=10, through=None: {"seq": t, "subject": "s", "producer": "p", "event_time_ns": t, "kind": kind, "ttl_ns": ttl, "through_ns": through, "payload": payload}
    state, out = coalescer.run_step(None, r(100))
    assert len(out) == 1
    state, out = coalescer.run_step(state, r(103))
    assert out == []  # absorbed
    state, out = coalescer.run_step(state, r(106))
    assert (out[0]["event_time_ns"], out[0]["through_ns"]) == (100, 106)  # extended
    state, out = coalescer.run_step(state, r(109))
    assert out == []
    same, out = coalescer.run_step(state, r(108))
    assert out == [] and same == state  # covered
    changed, out = coalescer.run_step(state, r(118, "y"))
    assert [(x["event_time_ns"], x["through_ns"], x["payload"]) for x in out] == [(100, 109, "x"), (118, None, "y")]  # the stored copy would have lapsed at 116
    late, out = coalescer.run_step(changed, r(104))
    assert out == [] and late == changed  # the run before covers it
    _, out = coalescer.run_step(changed, r(117, "z"))
    assert len(out) == 1  # older than the run and no part of it
    gone, out = coalescer.run_step(changed, r(119, kind="delete", ttl=0))
    assert gone is None and len(out) == 1
    _, out = coalescer.run_step(state, r(112), horizon=105)
    assert len(out) == 1 and out[0]["event_time_ns"] == 112  # a run from before the horizon is continued by a new one
    _, out = coalescer.run_step(state, r(118), horizon=105)
    assert [(x["event_time_ns"], x["through_ns"]) for x in out] == [(109, None), (118, None)]
    _, out = coalescer.run_step(state, r(112), max_age=True)
    assert len(out) == 1 and out[0]["event_time_ns"] == 112


def test_names_of_clusters():
    d = operate.name_decision
    assert d(None, False, 0, "a").record and d("a", True, 9, "a").ingest and not d("a", True, 9, "b").ingest
    assert d("a", True, 9, "b", "b") == operate.NameDecision(record=True) and d("a", True, 9, "b", "c").warning and not d(None, False, 9, "b").ingest
    assert d("a", True, 9, None, "").record and not d("a", True, 9, None).ingest


def test_retention_schedule():
    day, keep, now = operate.DAY_NS, 30 * operate.DAY_NS, 100 * operate.DAY_NS
    r = operate.retention
    assert operate.agreement(now, None, 0) == "unknown" and operate.agreement(now, now - 3 * day, 2 * day) == "agree" and operate.agreement(now, now - 3 * day, 0) == "disagree"
    assert r(now, None, "agree").horizon_ns == now - keep and r(now, None, "unknown").horizon_ns is None
    assert r(now, now - keep - day // 2, "agree").reason == "not due" and r(now, now - keep - day, "unknown").reason == "due"
    assert r(now, now - keep - 9 * day, "agree").reason == "catch up" and r(now, now - keep - 9 * day, "unknown").horizon_ns == now - keep - 7 * day
    assert r(now, now - keep - 9 * day, "unknown", since_capped_ns=5).reason == "capped already" and r(now, now - keep - 9 * day, "disagree").horizon_ns is None
    assert r(now, now - keep - day, "agree", pending=True).reason == "pending" and r(now, now, "agree").horizon_ns is None


def test_counter_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{k % 3}", "cumulative", k // 20, k, float(k * 7 % 5)) for k in range(1, 90)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    points = spark.createDataFrame(rows, "series string, temporality string, start_ns long, time_ns long, value double")
    batch = {tuple(r) for r in coalescer.counter_sightings(points, idle_ns=9, warm_from=3, evict_ns=None).collect()}
    for k in range(3):
        points.filter((F.col("time_ns") > k * 30) & (F.col("time_ns") <= k * 30 + 30)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = coalescer.counter_stream(stream, idle_ns=9, warm_from=3, evict_ns=None).writeStream.foreachBatch(coalescer.sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("series", "time_ns").collect()} == batch and len(batch) > 20


@pytest.mark.parametrize("received, want", [(None, 5), (T0, T0)])
def test_host_instants(spark, received, want):
    time = 5 if received is None else T0 + 10**12
    r = spark.createDataFrame([("entity.state", time, {"host.id": "h"}, {"entity.type": "host"}, received)], "event_name string, time_ns long, resource map<string,string>, attrs map<string,string>, received long")
    assert [x.event_time_ns for x in translate.host_records(r, "c", S, ident=plain, received="received").collect()] == [want]


def test_batch_runs_take_no_call_a_key(spark):
    """Keys that meet in a task or go on over batches of rows keep their own states."""
    rows = [(k * 10 + i, f"s{k}", "p", 100 + i, "observe", 50, None, "x") for k in range(200) for i in range(1 + k % 3)]
    log = spark.createDataFrame(rows, coalescer.RUN_SCHEMA).repartition(7)
    want = set()
    for k in range(200):
        state = None
        for r in (dict(zip(coalescer.RUN, x)) for x in rows if x[1] == f"s{k}"):
            state, out = coalescer.run_step(state, r)
            want |= {tuple(o[c] for c in coalescer.RUN) for o in out}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = coalescer.coalesce_batch(log)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
