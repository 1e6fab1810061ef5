"""A made-up cluster as a log: the same records for the same seed, at any size, from a range of numbers and hashes.

Every pod lives for a while on one node, is told of every ``beat`` and deleted or left to lapse; some pods
move; nodes stand on hosts in racks; pods hold instances of services that call each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

START_NS = 1_704_067_200_000_000_000
MINUTE_NS = 60_000_000_000

#: One query for Spark and DuckDB; what they write differently is filled in.
SQL = """
with p as (select id, {hash_pod} % {nodes} node, {hash_born} % {minutes} born, 1 + {hash_life} % 240 life, {hash_end} % 4 fate, id % {services} svc from {pods_table}),
b as (select p.*, beat from p {beats}),
pod as (select concat('k8s.pod:', cast(id as varchar(20))) s, concat('k8s.node:', cast(node as varchar(20))) n, born, life, fate, beat, id, svc from b),
r as (
select {start} + (born + beat * {beat}) * {minute} t, 'L2' layer, 'entity' subject_kind, s source, cast(null as varchar(40)) target, cast(null as varchar(20)) relation, 'observe' kind, 3 * {beat} * {minute} ttl_ns from pod
union all select {start} + (born + beat * {beat}) * {minute}, 'L2', 'edge', s, n, 'scheduled_on', 'observe', 3 * {beat} * {minute} from pod
union all select {start} + (born + life) * {minute}, 'L2', 'entity', s, null, null, 'delete', 0 from pod where beat = 0 and fate > 0
union all select {start} + (born + life) * {minute}, 'L2', 'edge', s, n, 'scheduled_on', 'delete', 0 from pod where beat = 0 and fate > 0
union all select {start} + born * {minute}, 'L2', 'entity', concat('service.instance:', cast(id as varchar(20))), null, null, 'observe', life * {minute} from pod where beat = 0
union all select {start} + born * {minute}, 'L2', 'edge', concat('service.instance:', cast(id as varchar(20))), s, 'part_of', 'observe', life * {minute} from pod where beat = 0
union all select {start} + born * {minute}, 'L2', 'edge', concat('service.instance:', cast(id as varchar(20))), concat('service:', cast(svc as varchar(20))), 'instance_of', 'observe', life * {minute} from pod where beat = 0
union all select {start}, 'L2', 'entity', concat('k8s.node:', cast(id as varchar(20))), null, null, 'observe', 0 from {nodes_table}
union all select {start}, 'L1', 'entity', concat('host:', cast(id as varchar(20))), null, null, 'observe', 0 from {nodes_table} where id % 2 = 0
union all select {start}, 'L1', 'edge', concat('k8s.node:', cast(id as varchar(20))), concat('host:', cast(id - id % 2 as varchar(20))), 'runs_on', 'observe', 0 from {nodes_table}
union all select {start}, 'L3', 'entity', concat('service:', cast(id as varchar(20))), null, null, 'observe', 0 from {services_table}
union all select {start}, 'L3', 'edge', concat('service:', cast(id as varchar(20))), concat('service:', cast((id * 7 + 1) % {services} as varchar(20))), 'depends_on', 'observe', 0 from {services_table} where (id * 7 + 1) % {services} <> id)
select t event_time_ns, layer, subject_kind, source, target, relation, 'demo' producer, kind, cast(ttl_ns as bigint) ttl_ns from r
"""


def text(numbers, hashed, beats: str, pods: int = 400, nodes: int = 20, services: int = 12, minutes: int = 1440, beat: int = 30, seed: int = 1) -> str:
    """The query for one engine: ``numbers(n)`` is a table with ids below n, ``hashed(text)`` 28 bits of the MD5 of a text, ``beats`` adds a row a beat."""
    own = {f"hash_{k}": hashed(f"concat('{seed}:{k}:', cast(id as varchar(20)))") for k in ("pod", "born", "life", "end")}
    tables = {"pods_table": numbers(pods), "nodes_table": numbers(nodes), "services_table": numbers(services), "beats": beats.format(beat=beat)}
    return SQL.format(**own, **tables, nodes=nodes, services=services, minutes=minutes, beat=beat, start=START_NS, minute=MINUTE_NS)


def world(spark: SparkSession, **size: int) -> DataFrame:
    """The records of a cluster, without seqs: pods, nodes, services, minutes, beat and seed set its size and shape."""
    hashed = lambda x: f"cast(conv(substring(md5({x}), 1, 7), 16, 10) as bigint)"
    return spark.sql(text(lambda n: f"(select id from range({n}))", hashed, "lateral view explode(sequence(0, p.life div {beat})) x as beat", **size))
