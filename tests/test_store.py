"""Sources and sinks: written, read back, broken."""

import random

import pytest
from pyspark.sql import functions as F

from strandlog import cli
from strandlog.sources import activity, capture, demo, segments
from strandlog.streaming import operate
from tests.test_engine import LOG, random_log


def test_restore_checks_the_chain(spark, tmp_path):
    log = spark.createDataFrame(random_log(random.Random(3)), LOG).withColumn("boot", F.lit(None).cast("string"))
    last, path = log.count(), str(tmp_path / "backup")
    activity.cut(log, path, 0, 40, 1)
    activity.cut(log, path, 40, 90, 2)
    activity.cut(log, path, 40, 90, 2)  # again: the same generation
    activity.cut(log, path, 90, last, 3)
    got = activity.restore(spark, path)
    assert sorted(r.seq for r in got.collect()) == list(range(1, last + 1)) and activity.dense(got)
    assert activity.differences(log, got).agg(F.sum("records")).first()[0] == 0
    other = str(tmp_path / "gap")
    activity.cut(log, other, 0, 40, 1)
    activity.cut(log, other, 50, last, 2)
    with pytest.raises(ValueError, match="starts after 50"):
        activity.restore(spark, other)
    short = str(tmp_path / "short")
    activity.cut(log, short, 0, last, 1)
    log.filter("seq > 10").withColumn("class", activity.class_of()).write.mode("overwrite").partitionBy("class").parquet(f"{short}/files/generation=1")
    with pytest.raises(ValueError, match="holds"):
        activity.restore(spark, short)


def test_checked_groups_tell_what_changed(spark, tmp_path):
    log = spark.createDataFrame(random_log(random.Random(4)), LOG)
    path = str(tmp_path / "log")
    activity.write(log, path, rows=20)
    assert activity.checked(spark, path, rows=20).filter("not ok").count() == 0
    activity.read(spark, f"{path}/records").withColumn("ttl_ns", F.when(F.col("seq") == 25, 99).otherwise(F.col("ttl_ns"))).write.parquet(str(tmp_path / "new"))
    spark.read.parquet(str(tmp_path / "new")).write.mode("overwrite").parquet(f"{path}/records")
    assert [r.group for r in activity.checked(spark, path, rows=20).filter("not ok").collect()] == [1]


def test_segments_are_whole_and_fixed(spark, tmp_path):
    held = segments.Segments(spark, f"file://{tmp_path}/s")
    assert held.list().count() == 0 and held.stat("a/1") is None
    held.put("a/1", b"one")
    held.put("a/1", b"one")
    held.put("a/2", b"")
    with pytest.raises(ValueError):
        held.put("a/1", b"two")
    for bad in ("../x", "a//b", "", ".hidden"):
        with pytest.raises(ValueError):
            held.put(bad, b"")
    assert held.open("a/1") == b"one" and held.stat("a/1") == 3
    assert {tuple(r) for r in held.list("a/").collect()} == {("a/1", 3), ("a/2", 0)}
    assert held.delete("a/1") and not held.delete("a/1") and [r.name for r in held.list().collect()] == ["a/2"]


def test_demo_is_the_same_for_a_seed(spark):
    a, b, c = (demo.world(spark, pods=30, seed=s) for s in (1, 1, 2))
    assert a.exceptAll(b).count() == 0 and a.exceptAll(c).count() > 0


def test_command_line(spark, tmp_path, capsys):
    log = spark.createDataFrame(random_log(random.Random(5)), LOG)
    log.write.parquet(str(tmp_path / "log"))
    assert cli.main([str(tmp_path / "log"), "alive", "--entity", "k8s.pod:1", "--at", "10"]) == 0
    assert cli.main([str(tmp_path / "log"), "history", "--entity", "k8s.pod:1"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith('{"entity":"k8s.pod:1","alive":') and all('"source":"k8s.pod:1"' in x for x in out[1:])
    with pytest.raises(ValueError):
        cli.main([str(tmp_path / "log"), "history", "--entity", "x", "--token", "100000"])


def test_commits_count_once(spark, tmp_path):
    log = spark.createDataFrame(random_log(random.Random(6)), LOG).withColumn("boot", F.lit(None).cast("string")).drop("seq")
    path = str(tmp_path / "out")
    order = ["event_time_ns", "source", "producer", "kind", "ttl_ns", "through_ns"]
    a, b = log.filter("event_time_ns < 20"), log.filter("event_time_ns >= 20").withColumn("ttl_ns", F.when(F.col("source") == "k8s.pod:1", -1).otherwise(F.col("ttl_ns")))
    operate.commit(a, 0, path, order)
    operate.commit(b, 1, path, order)
    operate.commit(b, 1, path, order)
    good = a.count() + b.filter("ttl_ns >= 0").count()
    rows = operate.read_committed(spark, path).collect()
    assert sorted(r.seq for r in rows) == list(range(1, good + 1))
    assert spark.read.parquet(f"{path}/rejected/batch=1").filter("reject_reason = 'negative ttl'").count() == b.filter("ttl_ns < 0").count()


def test_captured_lines_come_back(spark):
    rows = [(1, "entity.state", 5, 6, {"host.id": "h"}, {"entity.type": "host", "sequence": "2"}, "b"), (1, None, 7, None, {}, {"x": "y"}, None), (2, "entity.delete", 8, 9, {"host.id": "g"}, {"sequence": "1"}, "")]
    records = spark.createDataFrame(rows, "request int, event_name string, time_ns long, observed_ns long, resource map<string,string>, attrs map<string,string>, body string")
    back = capture.log_records(capture.log_lines(records))
    got = {(r.event_name, r.time_ns, r.observed_ns, tuple(sorted(r.resource.items())), tuple(sorted(r.attrs.items()))) for r in back.collect()}
    assert got == {(r[1], r[2], r[3], tuple(sorted(r[4].items())), tuple(sorted(r[5].items()))) for r in rows}
    assert [r.event_name for r in capture.in_order(back).orderBy("place").collect()] == ["entity.delete", "entity.state", None]
    assert {r.route for r in capture.route(back).collect()} == {"host", "legacy", "entity"}
