"""The engine against plain Python on random logs, and round trips of its formats."""

import random

import pytest
from pyspark.sql import functions as F

from strandlog.functions.identity import fingerprint, instant_ns, instant_text
from strandlog.functions.text import canonical_address, payload_object
from strandlog.operators import fold, log as reads, spans
from strandlog.plans import subgraph
from strandlog.schema import OPEN
from strandlog.streaming import coalescer

LOG = "seq long, event_time_ns long, layer string, subject_kind string, source string, target string, relation string, producer string, kind string, ttl_ns long, through_ns long, payload binary"


def random_log(rnd, subjects=25, n=12):
    rows, seq = [], 0
    for s in range(subjects):
        for _ in range(rnd.randint(1, n)):
            seq += 1
            t, delete = rnd.randint(0, 40), rnd.random() < 0.25
            ttl = 0 if delete else rnd.choice([0, 3, 8])
            through = None if delete or rnd.random() < 0.7 else t + rnd.randint(0, 4)
            rows.append((seq, t, "L2", "entity", f"k8s.pod:{s}", None, None, rnd.choice(["p", "q"]), "delete" if delete else "observe", ttl, through, b"x" if delete is False else None))
    rnd.shuffle(rows)
    return rows


def plain_alive(rows, subject, t):
    """Whether some producer's deciding record at t holds the subject alive."""
    for producer in ("p", "q"):
        own = [r for r in rows if r[4] == subject and r[7] == producer and r[1] <= t]
        if own:
            r = max(own, key=lambda r: (r[1], r[0]))
            if r[8] == "observe" and (r[9] == 0 or t < max(r[1], r[10] or r[1]) + r[9]):
                return True
    return False


@pytest.mark.parametrize("seed", [1, 2])
def test_existence_is_when_a_producer_holds_it(spark, seed):
    rows = random_log(random.Random(seed))
    log = spark.createDataFrame(rows, LOG)
    got = {}
    for r in fold.existence(log).collect():
        got.setdefault(r.source, []).append((r.start, r.end, r.end_source))
    for s in {r[4] for r in rows}:
        own = sorted(got.get(s, []))
        for t in range(0, 60):
            assert any(a <= t < b for a, b, _ in own) == plain_alive(rows, s, t), (s, t)
        assert all(b < c for (_, b, _), (c, _, _) in zip(own, own[1:]))  # maximal: runs never touch
        assert all((why is None) == (b == OPEN) for _, b, why in own)
    alive = {r.source for r in reads.alive_subjects(log, 20).collect()}
    assert alive == {s for s in {r[4] for r in rows} if plain_alive(rows, s, 20)}


def test_coalesce_and_since_change_no_answer(spark):
    rows = random_log(random.Random(5))
    log = spark.createDataFrame(rows, LOG)
    key = lambda df: {(r.subject, r.start, r.end, r.end_source) for r in fold.existence(df).collect()}
    assert key(fold.coalesce_runs(log)) == key(log)
    since = reads.window_since(log, 15, 100).drop("part")
    later = lambda k: {(s, max(a, 15), b, w) for s, a, b, w in k if b > 15}
    assert later(key(since)) == later(key(log))


def test_span_algebra_by_points(spark):
    rnd = random.Random(3)
    draw = lambda n: [(rnd.randint(0, 4), rnd.choice("xyz"), a, a + rnd.randint(1, 9)) for a in (rnd.randint(0, 40) for _ in range(n))]
    a, b = draw(40), draw(25)
    schema = "k int, target string, start long, end long"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    covers = lambda rows, k, t: any(r[0] == k and r[2] <= t < r[3] for r in rows)
    points = lambda df: {(r.k, t) for r in df.collect() for t in range(r.start, r.end)}
    every = [(k, t) for k in range(5) for t in range(60)]
    assert points(spans.union_spans(da.select("k", "start", "end"), ["k"])) == {p for p in every if covers(a, *p)}
    assert points(spans.subtract(da.select("k", "start", "end"), db.select("k", "start", "end"), ["k"])) == {p for p in every if covers(a, *p) and not covers(b, *p)}
    assert points(spans.intersect(da.select("k", "start", "end"), db.select("k", "start", "end"), ["k"])) == {p for p in every if covers(a, *p) and covers(b, *p)}
    claimed = lambda k, t: {r[1] for r in a if r[0] == k and r[2] <= t < r[3]}
    one = {(r.k, r.target, t) for r in spans.single_claim(da, ["k"], "target").collect() for t in range(r.start, r.end)}
    assert one == {(k, *claimed(k, t), t) for k, t in every if len(claimed(k, t)) == 1}
    assert points(spans.ambiguous(da, ["k"], "target")) == {p for p in every if len(claimed(*p)) > 1}


def test_appends_are_whole_or_refused(spark):
    log = spark.createDataFrame(random_log(random.Random(1)), LOG).withColumn("boot", F.lit(None).cast("string"))
    last = reads.last_seq(log)
    good = log.limit(1).withColumn("seq", F.lit(last + 1).cast("long"))
    assert reads.append(log, good).count() == log.count() + 1
    for bad in (good.withColumn("seq", F.lit(last).cast("long")), good.withColumn("ttl_ns", F.lit(-1).cast("long")), good.unionByName(good), good.withColumn("layer", F.lit("L1"))):
        with pytest.raises(reads.AppendRefused):
            reads.append(log, bad)
    with pytest.raises(ValueError):
        reads.resolve_token(log, last + 5, strict=True)
    with pytest.raises(reads.BeforeHorizon):
        reads.check_horizon({"L2": (10, 5)}, "L2", 9, 100)


def test_stream_state_equals_batch(spark, tmp_path):
    rows = random_log(random.Random(9), subjects=6, n=25)
    log = spark.createDataFrame(rows, LOG).withColumn("subject", F.col("source")).withColumn("payload", F.col("payload").cast("string"))
    batch = {tuple(r) for r in coalescer.coalesce_batch(log).collect()}
    for k in range(3):  # three files, in seq order
        log.filter((F.col("seq") % 1000) * 3 >= k * (len(rows) + 1)).filter(F.col("seq") * 3 < (k + 1) * (len(rows) + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = coalescer.coalesce_stream(stream).writeStream.foreachBatch(coalescer.sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").select(*coalescer.RUN).collect()}
    assert got == batch


def test_counter_cases():
    step = lambda s, *p, warm=False: coalescer.counter_step(s, *p, idle_ns=100, warm=warm)
    s, seen = step(None, 1, 10, 5.0)
    assert not seen and step(None, 1, 10, 5.0, warm=True)[1]
    assert step(s, 1, 10, 9.0) == (s, False)  # not after the last point
    assert step(s, 0, 20, 9.0) == (s, False)  # an older start
    assert step(s, 1, 20, 6.0)[1] and step(s, 2, 20, 1.0)[1] and step(s, 1, 20, 4.0)[1]
    assert not step(s, 1, 20, 5.0)[1] and step(s, 1, 200, 5.0)[1]


def test_fingerprints_and_instants(spark):
    df = spark.createDataFrame([("h1", "2024-01-01T00:00:00.000000001Z", "7"), (" ", "x", "07"), (None, "2024-01-01T01:00:00+01:00", "-0")], "id string, t string, n string")
    r = df.select(fingerprint("host", {"host.id": F.col("id")}, "n/x").alias("f"), instant_ns(F.col("t")).alias("ns"), fingerprint("process", {"host.id": F.lit("h"), "process.pid": F.col("n"), "process.creation.time": F.col("t")}).alias("p")).collect()
    import hashlib

    pre = b"n/x\x01\0\0\0\4host\0\0\0\1\0\0\0\7host.id\1\0\0\0\2h1"
    assert r[0].f == "host:" + hashlib.sha256(pre).hexdigest()[:32] and r[1].f is None and r[2].f is None
    assert [x.ns for x in r] == [1704067200000000001, None, 1704067200000000000]
    assert r[0].p and not r[1].p and not r[2].p
    assert spark.range(1).select(instant_text(F.lit(1704067200000000010)).alias("t")).first().t == "2024-01-01T00:00:00.00000001Z"


def test_addresses_and_payloads():
    assert canonical_address("10.42.0.5", "default") == ("k8s/default", "10.42.0.5")
    assert canonical_address("8.8.8.8", "c") == ("global", "8.8.8.8")
    assert canonical_address("::ffff:8.8.8.8", "c") == ("global", "8.8.8.8")
    assert canonical_address("2A00:0:0::1", "c") == ("global", "2a00::1")
    assert canonical_address("010.1.1.1", "c") is None and canonical_address("fe80::1%eth0", "c") is None
    assert payload_object(b"") == {} and payload_object(b"[1]") is None and payload_object(b'{"a":1.0}') != payload_object(b'{"a":1}')


def test_subgraph_codec_and_seek(spark):
    pieces = spark.createDataFrame([(f"e{k % 7}", "entity", f"e{k % 7}", None, None, a, a + 5, "producer") for k, a in enumerate(range(0, 90, 6))], "subject string, subject_kind string, source string, target string, relation string, start long, end long, end_source string")
    n = subgraph.dictionary(pieces)
    ch = subgraph.deltas(pieces, n, 0, 100)
    fr = subgraph.keyframes(pieces, n, ch, 0)
    el = subgraph.keyframe_elements(pieces, n, fr, 0)
    number = {r.subject: r.element for r in n.collect()}
    for t in (0, 3, 5, 44, 70, 99):
        want = {number[r.subject] for r in pieces.collect() if r.start <= t < r.end}
        assert {r.element for r in subgraph.seek(el, ch, fr, t).collect()} == want
    changes = sorted((r["at"], r.element, r.appear, r.reason) for r in ch.collect())
    frames = [(r["at"], []) for r in fr.orderBy("at").collect()]
    data = subgraph.encode(sorted(number), changes, frames)
    assert subgraph.decode(data) == (sorted(number), changes, frames)
    for bad in (data[:-1], data[:20] + data[21:], b"x" + data):
        with pytest.raises((ValueError, IndexError)):
            subgraph.decode(bad)


def test_service_blast_radius_goes_to_its_end(spark):
    from strandlog.plans.all_queries import QUERIES

    rows = QUERIES["q15_blast_radius_services"](spark, "/root/testdata/sf0.001").collect()
    assert {r.depth for r in rows} == {1, 2, 3, 4}  # nothing new is reached at depths 5 and 6


def test_windows_need_no_history(spark):
    """What is folded for a window is its seeds and its own records, and answers are those of the whole log."""
    from strandlog.operators import checkpoints, ranges

    rows = random_log(random.Random(15), subjects=30, n=14)
    log = spark.createDataFrame(rows, LOG)
    whole = ranges.clip(fold.existence(log.filter(F.col("event_time_ns") < 30)), 15, 30)
    key = lambda df: {(r.subject, r.start, r.end, r.before, r.end_source) for r in df.collect()}
    assert key(ranges.entity_pieces(log, 15, 30)) == key(whole)
    last = reads.last_seq(log)
    for at, through in ((10, last), (10, last // 2), (15, last // 3), (40, last)):
        points = checkpoints.checkpoint(log, at, through)
        got = {(r.seq, r.part) for r in checkpoints.window_since(log, points, 15, 30, last).collect()}
        assert got == {(r.seq, r.part) for r in reads.window_since(log.drop("payload"), 15, 30).collect()}
    with pytest.raises(reads.BeforeHorizon):
        ranges.entity_pieces(log, 15, 30, horizons={"L2": (16, 0)})
    assert not checkpoints.due(log, checkpoints.checkpoint(log, 10, last), 10**18)


def test_scans_are_pruned(spark):
    from strandlog.sources import fixtures

    log = fixtures.placements(spark, "/root/testdata/sf0.001")
    q = log.filter("layer = 'L1' and subject_kind = 'edge' and event_time_ns >= 1704844800000000000 and seq <= 500").select("source")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "layer" in plan.split("PartitionFilters:")[1].split("]")[0] and "GreaterThanOrEqual(event_time_ns" in plan.split("PushedFilters:")[1].split("]")[0]
    assert "payload" not in plan.split("ReadSchema:")[1]


def test_numbers_are_dense_and_in_order(spark):
    from strandlog.operators.order import numbered

    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(500)], "k int, i int").repartition(7)
    rows = numbered(df, ["k", "i"], "n", 10).collect()
    assert [(r.k, r.i) for r in sorted(rows, key=lambda r: r.n)] == sorted((r.k, r.i) for r in rows)
    assert sorted(r.n for r in rows) == list(range(11, 511))
    assert numbered(df.limit(0), ["k"], "n").count() == 0
    plan = numbered(df, ["k"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_quarantined_hosts_are_shown(spark):
    from strandlog.plans import questions

    rows = [(k + 1, t, "L1", "entity", "host:1", None, None, "n", "observe", 0, None, None, b) for k, (t, b) in enumerate([(0, "a"), (5, "b"), (9, "a")])]
    log = spark.createDataFrame(rows, LOG + ", boot string")
    with pytest.raises(reads.Quarantined):
        reads.alive(log, ["host:1"], 7)
    assert [r.alive for r in reads.alive(log.filter("boot = 'a'"), ["host:1"], 7).collect()] == [True]
    assert questions.existence_of(log, spark.createDataFrame([("host:1",), ("host:2",)], "entity string"), 7).collect()[0].existence in ("quarantined", "not_alive")


def test_descriptions_before_the_horizon_are_refused(spark):
    from strandlog.plans import questions

    log = spark.createDataFrame([(1, 5, "L2", "entity", "k8s.pod:1", None, None, "p", "observe", 0, None, b"{}")], LOG)
    assert questions.descriptions(log, 10, 20, horizons={"L2": 4}).count() == 1
    with pytest.raises(questions.Retained):
        questions.descriptions(log, 10, 20, horizons={"L2": 8})


def test_names_are_those_of_the_type(spark):
    from strandlog.functions.text import payload_name, payload_namespace, shown_payload

    rows = [('{"k8s.node.name":"n","k8s.pod.name":"p"}',), ('{"name":7,"k8s.pod.name":"p"}',), ('{"name":"a\\u200bb"}',), ("junk",), (None,), ('{"name":"","k8s.pod.name":"q","namespace":"s"}',)]
    df = spark.createDataFrame(rows, "p string").select(F.col("p").cast("binary").alias("p"))
    got = df.select(payload_name(F.col("p"), "k8s.pod").alias("n"), payload_namespace(F.col("p"), "k8s.pod").alias("s"), payload_name(F.col("p"), "host").alias("h"), shown_payload(F.col("p"), "k8s.node").alias("x")).collect()
    assert [r.n for r in got] == ["p", "p", "a\u200bb", None, None, "q"] and got[5].s == "s" and all(r.h is None for r in got)
    assert got[0].x.shown == '{"k8s.node.name":"n"}' and got[0].x.withheld == "k8s.pod.name"
    assert got[2].x.withheld == "name" and got[3].x.shown == "{}"


def test_cache_keys_and_json(spark):
    from strandlog.plans import subgraph

    key = subgraph.cache_key("scope", ["a", "b"], {"x": 1, "y": 2}, 7, 0, 9)
    assert key == subgraph.cache_key("scope", ["a", "b"], {"y": 2, "x": 1}, 7, 0, 9)
    assert len({key, subgraph.cache_key("scope", ["b", "a"], {"x": 1, "y": 2}, 7, 0, 9), subgraph.cache_key("scope", ["a", "b"], {"x": 1, "y": 2}, 8, 0, 9)}) == 3
    assert len(subgraph.catalog_digest()) == 64
    with pytest.raises(ValueError):
        subgraph.read_scope(spark.createDataFrame([], LOG), spark.range(300).select(F.col("id").cast("string").alias("entity")), 0, 9)
