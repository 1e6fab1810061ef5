"""The registered queries of the engine over the projected logs, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog import schema
from strandlog.functions.identity import NAMESPACE, fingerprint
from strandlog.operators import fold, log as reads, ranges, spans
from strandlog.plans import questions as q, scoring, subgraph
from strandlog.schema import OPEN
from strandlog.sources import activity, fixtures
from strandlog.streaming import coalescer

T = 1705752000000000000  #: 2024-01-20 12:00 UTC
FROM, TO = 1704844800000000000, 1706140800000000000  #: 2024-01-10 and 2024-01-25
TOKEN = 12000
SEED_HOST = "host:1"


def _end(c: str = "end"):
    return F.when(F.col(c) < OPEN, F.col(c)).alias(c)


def _pods(log: DataFrame) -> DataFrame:
    return log.filter("subject_kind = 'entity' and source like 'k8s.pod:%'").select(F.col("source").alias("entity")).distinct()


def _seed(log: DataFrame) -> DataFrame:
    """The pod with the least id: one row."""
    return log.filter("subject_kind = 'entity' and source like 'k8s.pod:%'").agg(F.min("source").alias("entity"))


def q1_neighbors_at(s: SparkSession, d: str) -> DataFrame:
    return q.neighbors_at(fixtures.placements(s, d), T).select("entity", "peer", "relation")


def q1_neighbors_at_token(s, d):
    return q.neighbors_at(fixtures.placements(s, d), T, TOKEN).select("entity", "peer", "relation")


def st4_neighbors_reverse(s, d):
    log = fixtures.placements(s, d)
    nodes = log.filter("subject_kind = 'entity' and source like 'k8s.node:%'").select(F.col("source").alias("entity")).distinct()
    return reads.neighbors(log, nodes, T, "reverse")


def st6_alive(s, d):
    return reads.alive_subjects(fixtures.placements(s, d).filter("subject_kind = 'entity'"), T).select("subject")


def st7_window(s, d):
    return reads.window(fixtures.placements(s, d), FROM, TO, "edge").select("seq", "source", "target", "event_time_ns", "kind")


def st9_window_since(s, d):
    return reads.window_since(fixtures.placements(s, d).drop("payload"), FROM, TO).select("seq", "part")


def st11_last_assertion(s, d):
    log = fixtures.placements(s, d).drop("payload")
    refs = log.select(schema.subject_key().alias("subject"), "producer").distinct()
    return reads.last_assertion(log, refs, {"L2": FROM}).select("subject", "producer", "outcome", "seq")


def st16_edge_violations(s, d):
    """A log in which every seventh edge claims a relation that the catalog does not allow there."""
    log = fixtures.placements(s, d).withColumn("relation", F.when((F.col("subject_kind") == "edge") & (F.col("seq") % 7 == 0), "part_of").otherwise(F.col("relation")))
    return schema.edge_violations(s, log).select("seq", "relation")


def lf11_reject_reasons(s, d):
    log = fixtures.placements(s, d).withColumn("boot", F.lit(None).cast("string")).withColumn("ttl_ns", F.when(F.col("seq") % 11 == 0, F.lit(-1)).otherwise(F.col("ttl_ns")))
    return schema.reject_reason(log).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def lf3_existence(s, d):
    return fold.existence(fixtures.placements(s, d)).select("subject", "start", _end(), "end_source")


def lf3_existence_by_producer(s, d):
    return fold.existence_by_producer(fixtures.placements(s, d)).select("subject", "producer", "start", _end(), "end_source")


def lf5_describe_at(s, d):
    ranks = s.createDataFrame([("p2", 5), ("p0", 1)], "producer string, rank int")
    return fold.describe_at(fixtures.placements(s, d).filter("subject_kind = 'entity'"), T, F.broadcast(ranks)).select("subject", "producer", F.decode("payload", "UTF-8").alias("payload"))


def lf7_boots(s, d):
    return fold.boots(fixtures.boots(s, d))


def lf8_quarantine(s, d):
    return fold.quarantined(fixtures.boots(s, d))


def lf10_coalesce(s, d):
    return fold.coalesce_runs(fixtures.placements(s, d)).select("seq", "event_time_ns", "source", "target", "producer", "kind", "ttl_ns", "through_ns")


def iv1_entity_pieces(s, d):
    return ranges.entity_pieces(fixtures.placements(s, d), FROM, TO).select("subject", "start", "end", "before", "end_source")


def iv2_edge_pieces(s, d):
    return ranges.edge_pieces(fixtures.placements(s, d), FROM, TO).select("subject", "start", "end", "before", "end_source")


def iv3_raw_edge_pieces(s, d):
    return ranges.edge_pieces(fixtures.placements(s, d), FROM, TO, raw=True).select("subject", "start", "end", "before", "end_source")


def iv6_producers(s, d):
    log = fixtures.placements(s, d)
    return ranges.producers_of(ranges.entity_pieces(log, FROM, TO), log.filter("subject_kind = 'entity'").filter(F.col("event_time_ns") < TO)).select("subject", "start", "end", "producers")


def iv7_classes(s, d):
    return ranges.classify(ranges.edge_pieces(fixtures.placements(s, d), FROM, TO), FROM, TO)


def iv10_view_at(s, d):
    return ranges.view_at(ranges.edge_pieces(fixtures.placements(s, d), FROM, TO), T).select("subject", "start", "end")


def _claims(s, d):
    e = ranges.edge_pieces(fixtures.placements(s, d), FROM, TO).filter("relation = 'scheduled_on'")
    return e.select(F.col("source").alias("pod"), F.col("target").alias("node"), "start", "end")


def iv13_duration(s, d):
    return spans.duration(_claims(s, d), ["pod"])


def iv14_union(s, d):
    return spans.union_spans(_claims(s, d).select("node", "start", "end"), ["node"])


def iv17_single_claim(s, d):
    return spans.single_claim(_claims(s, d), ["pod"], "node")


def q2_entity_history(s, d):
    log = fixtures.placements(s, d)
    nodes = log.filter("subject_kind = 'entity' and source like 'k8s.pod:%'").select(F.col("source").alias("entity"))
    return q.entity_history(log, nodes, FROM, TO).select("source", "start", "end", "end_source", "producers")


def q6_graph_diff(s, d):
    return q.graph_diff(fixtures.placements(s, d), FROM, TO - 1).select("subject", "bucket", "transient", "start", "end", "end_source", "change")


def q6_diff_counts(s, d):
    return q.diff_counts(q.graph_diff(fixtures.placements(s, d), FROM, TO - 1))


def q8_change_events(s, d):
    return q.change_events(fixtures.placements(s, d), FROM, TO)


def q17_recency(s, d):
    return q.recency(fixtures.placements(s, d), TO - 1).select("subject", "producer", "last_seen", "silent_ns", F.round("confidence", 9).alias("confidence"))


def _placed(s, d, t):
    """(case, entity): the pods on each node at an instant."""
    edges = fixtures.placements(s, d).filter("relation = 'scheduled_on'")
    return reads.alive_subjects(edges, t).select(F.col("target").alias("case"), F.col("source").alias("entity")).distinct()


def q24_case_scores(s, d):
    """The pods on each node five days before, taken as a prediction of those on it now."""
    return scoring.case_scores(_placed(s, d, T - 5 * 86400 * q.SECOND).withColumn("rank", F.lit(1)), _placed(s, d, T)).drop("precision", "recall", "f1")


def _subgraph(s, d):
    pieces = ranges.edge_pieces(fixtures.placements(s, d), FROM, TO).filter("relation = 'scheduled_on'")
    numbers = subgraph.dictionary(pieces)
    return pieces, numbers, subgraph.deltas(pieces, numbers, FROM, TO)


def q18_subgraph_deltas(s, d):
    return _subgraph(s, d)[2]


def q21_without(s, d):
    pieces = _subgraph(s, d)[0]
    kept, _ = subgraph.without(pieces, s.createDataFrame([("k8s.node:3",)], "entity string"))
    return kept.select("subject", "start", "end")


def sc14_backup_classes(s, d):
    return fixtures.placements(s, d).groupBy(activity.class_of().alias("class")).agg(F.count(F.lit(1)).alias("records"), F.max("seq").alias("max_seq"))


def sc16_retirable(s, d):
    return activity.retirable(activity.file_reach(fixtures.services(s, d), 8), 820454400000000000, 2592000000000000)


def sc19_list_entities(s, d):
    return reads.list_entities(fixtures.placements(s, d), "k8s.pod", "k8s.pod:3", 50)


def rt1_retain(s, d):
    return reads.retain(fixtures.placements(s, d), {"L2": FROM}).select("seq", "layer", F.octet_length("payload").alias("payload_bytes"))


def sm5_coalescer(s, d):
    log = fixtures.placements(s, d).withColumn("subject", schema.subject_key()).withColumn("payload", F.decode("payload", "UTF-8"))
    return coalescer.coalesce_batch(log)


def sf1_fingerprints(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", fingerprint("host", {"host.id": F.col("c_name")}).alias("fingerprint"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k.split("_")[0][:-1].rstrip("0123456789") in ("q", "st", "lf", "iv", "sc", "rt", "sm", "sf") and not k.startswith("_") and getattr(f, "__module__", "") == __name__}

# -- the same in SQL ------------------------------------------------------------------------------
_A = "a as (" + fixtures.in_duckdb(fixtures.PLACEMENTS) + ")"
_SVC = "a as (" + fixtures.in_duckdb(fixtures.SERVICES, "o.o_orderdate") + ")"
_LIVE = "(kind = 'observe' and (ttl_ns = 0 or {t} < greatest(event_time_ns, coalesce(through_ns, event_time_ns)) + ttl_ns))"


def _live(t) -> str:
    return _LIVE.format(t=t)


def _latest(name: str, source: str, t: int) -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by concat_ws(' ', source, relation, target), producer order by event_time_ns desc, seq desc) rn from {source} where event_time_ns <= {t}) where rn = 1)"


def _fold(name: str, source: str, by_producer: bool = False) -> str:
    """CTEs that end in ``name``: subject, subject_kind, source, target, relation, s, e, why (and producer)."""
    key = "subject, producer" if by_producer else "subject"
    n = name
    return f"""{n}1 as (select * from (select *, concat_ws(' ', source, relation, target) subject,
  row_number() over (partition by concat_ws(' ', source, relation, target), producer, event_time_ns order by seq desc) rn from {source}) where rn = 1),
{n}2 as (select *, lead(event_time_ns) over (partition by subject, producer order by event_time_ns) nxt, lead(kind) over (partition by subject, producer order by event_time_ns) nk,
  case when ttl_ns = 0 then {OPEN} else greatest(event_time_ns, coalesce(through_ns, event_time_ns)) + ttl_ns end lapse from {n}1),
{n}3 as (select *, event_time_ns s, case when nxt is null or (ttl_ns > 0 and lapse < nxt) then lapse else nxt end e,
  case when nxt is null or (ttl_ns > 0 and lapse < nxt) then (case when lapse = {OPEN} then 0 else 1 end) when nk = 'delete' then 2 else 0 end st from {n}2 where kind = 'observe'),
{n}4 as (select *, max(e) over (partition by {key} order by s range between unbounded preceding and 1 preceding) pm from {n}3),
{n}5 as (select *, sum(case when pm is null or s > pm then 1 else 0 end) over (partition by {key} order by s range between unbounded preceding and current row) run from {n}4),
{n}6 as (select {key}, run, min(subject_kind) subject_kind, min(source) source, min(target) target, min(relation) relation, min(s) s, max(e) e from {n}5 group by {key}, run),
{n} as (select f.*, case when f.e = {OPEN} then null else (select case max(st) when 2 then 'producer' when 1 then 'liveness_expiry' end from {n}5 g where g.subject = f.subject and g.run = f.run and g.e = f.e{' and g.producer = f.producer' if by_producer else ''}) end why from {n}6 f)"""


_PAST = _A + f", past as (select * from a where event_time_ns < {TO})"
_ENT = _fold("en", "(select * from past where subject_kind = 'entity')")
_EDG = _fold("ed", "(select * from past where subject_kind = 'edge')")
_CUT = """c1 as (select ed.subject, ed.source, ed.target, ed.relation, greatest(ed.s, en.s) s, least(ed.e, en.e) e, case when ed.e <= en.e then ed.why else 'cascade' end why
  from ed join en on ed.source = en.source and ed.s < en.e and en.s < ed.e),
c2 as (select c1.subject, c1.source, c1.target, c1.relation, greatest(c1.s, en.s) s, least(c1.e, en.e) e, case when c1.e <= en.e then c1.why else 'cascade' end why
  from c1 join en on c1.target = en.source and c1.s < en.e and en.s < c1.e)"""


def _clip(name: str, source: str, start: int = FROM, to: int = TO) -> str:
    return f'{name} as (select subject, source, target, relation, greatest(s, {start}) "start", least(e, {to}) "end", s < {start} "before", case when e < {to} then why end end_source from {source} where s < {to} and e > {start})'


def pieces_of(log: str, start: int = FROM, to: int = TO) -> str:
    """CTEs over the log in ``a``: edge pieces in ep, entity pieces in np."""
    past = log + f", past as (select * from a where event_time_ns < {to})"
    return f"with {past}, {_ENT}, {_EDG}, {_CUT}, " + _clip("ep", "c2", start, to) + ", " + _clip("np", "en", start, to)


_PIECES = pieces_of(_A)
_BOTH = ", bp as (select *, 'edge' subject_kind from ep union all select *, 'entity' from np)"


def _islands(name: str, source: str, by: str) -> str:
    return f"""{name}1 as (select *, max("end") over (partition by {by} order by "start" range between unbounded preceding and 1 preceding) pm from {source}),
{name}2 as (select *, sum(case when pm is null or "start" > pm then 1 else 0 end) over (partition by {by} order by "start" range between unbounded preceding and current row) run from {name}1),
{name} as (select {by}, min("start") "start", max("end") "end" from {name}2 group by {by}, run)"""


def _single(name: str, source: str, by: str, target: str) -> str:
    """Spans with one target: elementary stretches of the boundaries that exactly one claim covers."""
    on = " and ".join(f"x.{c.strip()} = y.{c.strip()}" for c in by.split(","))
    cols = ", ".join(f"x.{c.strip()}" for c in by.split(","))
    return f"""{name}b as (select distinct {by}, "start" p from {source} union select distinct {by}, "end" from {source}),
{name}e as (select {by}, p "start", lead(p) over (partition by {by} order by p) "end" from {name}b),
{name}s as (select {cols}, min(y.{target}) {target}, x."start", x."end" from {name}e x join {source} y on {on} and y."start" <= x."start" and y."end" >= x."end" where x."end" is not null group by {cols}, x."start", x."end" having count(distinct y.{target}) = 1),
""" + _islands(name, f"{name}s", f"{by}, {target}")


_CLAIMS = _PIECES + """, cl as (select source pod, target node, "start", "end" from ep where relation = 'scheduled_on')"""
_ALIVE_EDGES = ", al as (select distinct source entity, target peer, relation from le where " + _live(T) + ")"
_IDS = ", ids as (select distinct source id from ln where " + _live(T) + ")"


def _neighbors(source: str) -> str:
    return f"with {_A}, k as ({source}), " + _latest("le", "(select * from k where subject_kind = 'edge')", T) + ", " + _latest("ln", "(select * from k where subject_kind = 'entity')", T) + _ALIVE_EDGES + _IDS + " select * from al where entity in (select id from ids) and peer in (select id from ids)"


_CLASSES = f"""select subject, count(*) n_pieces, case when count(*) > 1 then 'flapping' when min("start") = {FROM} and max("end") = {TO} then 'stable'
  when min("start") = {FROM} then 'disappeared' when max("end") = {TO} then 'appeared' else 'transient' end "class",
  cast(sum(("start" > {FROM})::int + ("end" < {TO})::int) as bigint) transitions, cast(sum("end" - "start") as bigint) duration_ns from """
_DESCRIBE = lambda n, t: _latest(f"{n}l", "(select * from past where subject_kind = 'entity')", t) + f", {n} as (select source subject, producer, payload from (select *, row_number() over (partition by source order by producer) rk from {n}l where {_live(t)}) where rk = 1)"
_DIFF = _PIECES + _BOTH + ", " + _DESCRIBE("d1", FROM) + ", " + _DESCRIBE("d2", TO - 1) + f""",
ch as (select d1.subject, case when d1.producer <> d2.producer then 'source_changed'
   when try_cast(d1.payload as json) is null or left(d1.payload, 1) <> '{{' or try_cast(d2.payload as json) is null or left(d2.payload, 1) <> '{{' then 'opaque' else 'keys' end change
  from d1 join d2 on d1.subject = d2.subject where d1.producer <> d2.producer or d1.payload <> d2.payload),
cs as ({_CLASSES} bp group by subject),
ends as (select subject, min(subject_kind) subject_kind, min("start") "start", max("end") "end", arg_max(coalesce(end_source, ''), "end") es from bp group by subject),
df as (select x.subject, subject_kind, case when "start" > {FROM} and "end" = {TO} then 'created' when "start" = {FROM} and "end" < {TO} then 'deleted'
  when "start" = {FROM} and "end" = {TO} and subject_kind = 'entity' and change is not null then 'changed' end bucket, "class" in ('transient', 'flapping') "transient", "start", "end", nullif(es, '') end_source, change
  from ends x join cs on x.subject = cs.subject left join ch on ch.subject = x.subject)"""

_B = "a as (" + fixtures.in_duckdb(fixtures.BOOTS) + ")"
_SEEN = ", sn as (select distinct source, boot, unnest([event_time_ns, greatest(event_time_ns, coalesce(through_ns, event_time_ns))]) \"at\" from a), bt as (select source, boot, min(\"at\") first_seen, max(\"at\") last_seen from sn group by source, boot)"

ORACLE = {
    "q1_neighbors_at": _neighbors("select * from a"),
    "q1_neighbors_at_token": _neighbors(f"select * from a where seq <= {TOKEN}"),
    "st4_neighbors_reverse": f"with {_A}, " + _latest("le", "(select * from a where subject_kind = 'edge' and target like 'k8s.node:%')", T) + f" select distinct target entity, source peer, relation from le where {_live(T)}",
    "st6_alive": f"with {_A}, " + _latest("le", "(select * from a where subject_kind = 'entity')", T) + f" select distinct source subject from le where {_live(T)}",
    "st7_window": f"with {_A} select seq, source, target, event_time_ns, kind from a where subject_kind = 'edge' and event_time_ns >= {FROM} and event_time_ns < {TO}",
    "st9_window_since": f"with {_A}, " + _latest("le", "a", FROM - 1) + f" select seq, 'seed' part from le where {_live(FROM - 1)} union all select seq, 'window' from a where event_time_ns >= {FROM} and event_time_ns < {TO}",
    "st11_last_assertion": f"with {_A}, " + _latest("le", "a", OPEN) + f" select concat_ws(' ', source, relation, target) subject, producer, case when layer = 'L2' and event_time_ns < {FROM} then 'baseline_only' else 'found' end outcome, seq from le",
    "st16_edge_violations": f"with {_A} select seq, 'part_of' relation from a where subject_kind = 'edge' and seq % 7 = 0",
    "lf11_reject_reasons": f"with {_A}, x as (select *, case when seq % 11 = 0 then -1 else ttl_ns end t2 from a) select case when t2 < 0 then 'negative ttl' when kind = 'delete' and (t2 <> 0 or through_ns is not null or payload <> '') then 'delete with ttl, through or payload' else 'valid' end reason, count(*) n from x group by 1",
    "lf3_existence": f"with {_A}, " + _fold("en", "a") + f' select subject, s "start", case when e < {OPEN} then e end "end", why end_source from en',
    "lf3_existence_by_producer": f"with {_A}, " + _fold("en", "a", True) + f' select subject, producer, s "start", case when e < {OPEN} then e end "end", why end_source from en',
    "lf5_describe_at": f"with {_A}, " + _latest("le", "(select * from a where subject_kind = 'entity')", T) + f" select subject, producer, payload from (select source subject, producer, payload, row_number() over (partition by source order by case producer when 'p2' then 5 when 'p0' then 1 else -1 end desc, producer) rk from le where {_live(T)}) where rk = 1",
    "lf7_boots": f"with {_B}{_SEEN} select * from bt",
    "lf8_quarantine": f"""with {_B}{_SEEN}, nw as (select *, lead(first_seen) over (partition by source order by first_seen, boot) newer from bt),
co as (select sn.source, sn.boot, sn."at", row_number() over (partition by sn.source order by sn."at", sn.boot) rk from sn join nw on sn.source = nw.source and sn.boot = nw.boot where sn."at" > newer)
select source, boot, "at" from co where rk = 1""",
    "lf10_coalesce": f"""with {_A}, e as (select * from (select *, concat_ws(' ', source, relation, target) subject, row_number() over (partition by concat_ws(' ', source, relation, target), producer, event_time_ns order by seq desc) rn from a) where rn = 1),
l as (select *, greatest(event_time_ns, coalesce(through_ns, event_time_ns)) lst from e),
g as (select *, case when kind = 'observe' and lag(kind) over w = 'observe' and payload = lag(payload) over w and ttl_ns = lag(ttl_ns) over w and event_time_ns > lag(lst) over w and (ttl_ns = 0 or event_time_ns <= lag(lst) over w + lag(ttl_ns) over w) then 0 else 1 end nw
  from l window w as (partition by subject, producer order by event_time_ns)),
r as (select *, sum(nw) over (partition by subject, producer order by event_time_ns rows between unbounded preceding and current row) run from g)
select max(seq) seq, min(event_time_ns) event_time_ns, min(source) source, min(target) target, producer, min(kind) kind, min(ttl_ns) ttl_ns, case when max(lst) > min(event_time_ns) then max(lst) end through_ns from r group by subject, producer, run""",
    "iv1_entity_pieces": _PIECES + ' select subject, "start", "end", "before", end_source from np',
    "iv2_edge_pieces": _PIECES + ' select subject, "start", "end", "before", end_source from ep',
    "iv3_raw_edge_pieces": f"with {_PAST}, {_EDG}, " + _clip("ep", "ed") + ' select subject, "start", "end", "before", end_source from ep',
    "iv6_producers": _PIECES + ", " + _fold("bp", "(select * from past where subject_kind = 'entity')", True) + ' select np.subject, np."start", np."end", string_agg(distinct bp.producer, \',\' order by bp.producer) producers from np join bp on np.subject = bp.subject and bp.s < np."end" and np."start" < bp.e group by np.subject, np."start", np."end"',
    "iv7_classes": _PIECES + " " + _CLASSES + " ep group by subject",
    "iv10_view_at": _PIECES + f' select subject, "start", "end" from ep where "start" <= {T} and "end" > {T}',
    "iv13_duration": _CLAIMS + ' select pod, cast(sum("end" - "start") as bigint) duration_ns from cl group by pod',
    "iv14_union": _CLAIMS + ", " + _islands("u", "cl", "node") + " select * from u",
    "iv17_single_claim": _CLAIMS + ", " + _single("sc", "cl", "pod", "node") + " select * from sc",
    "q2_entity_history": _PIECES + ", " + _fold("bp", "(select * from past where subject_kind = 'entity')", True) + """, pr as (select np.subject, np."start", string_agg(distinct bp.producer, ',' order by bp.producer) producers from np join bp on np.subject = bp.subject and bp.s < np."end" and np."start" < bp.e group by np.subject, np."start")
select i.source, np."start", np."end", np.end_source, producers from (select distinct source from a where subject_kind = 'entity' and source like 'k8s.pod:%') i left join np on np.source = i.source left join pr on pr.subject = np.subject and pr."start" = np."start\"""",
    "q6_graph_diff": _DIFF + " select subject, bucket, \"transient\", \"start\", \"end\", end_source, case when bucket = 'changed' then change end change from df where bucket is not null or \"transient\"",
    "q6_diff_counts": _DIFF + ", b as (select subject_kind, bucket from df where bucket is not null union all select subject_kind, 'transient' from df where \"transient\") select bucket, count(*) filter (where subject_kind = 'entity') entities, count(*) filter (where subject_kind = 'edge') edges from b group by bucket",
    "q8_change_events": _PIECES + _BOTH + f' select "start" "at", subject, true appear, cast(null as varchar) end_source from bp where "start" > {FROM} union all select "end", subject, false, end_source from bp where "end" < {TO}',
    "q17_recency": f"with {_A}, p as (select * from (select *, concat_ws(' ', source, relation, target) subject, row_number() over (partition by concat_ws(' ', source, relation, target), producer, event_time_ns order by seq desc) rn from a where event_time_ns <= {TO - 1}) where rn = 1), " + f"""
m as (select subject, producer, max(greatest(event_time_ns, coalesce(through_ns, event_time_ns))) filter (where kind = 'observe') latest from p group by subject, producer),
l as (select * from (select *, row_number() over (partition by subject, producer order by event_time_ns desc) rk from p) where rk = 1 and {_live(TO - 1)}),
v as (select l.subject, l.producer, l.ttl_ns, least({TO - 1}, greatest(event_time_ns, coalesce(through_ns, event_time_ns), latest)) last_seen, cast(floor(ttl_ns * 0.5) as bigint) x, min(ttl_ns) over (partition by l.subject) w from l join m on l.subject = m.subject and l.producer = m.producer),
z as (select *, greatest(0, {TO - 1} - last_seen - x) silent_ns from v where w > 0)
select subject, producer, last_seen, silent_ns, round(case when silent_ns <= 0 then 1.0 else pow(2.0::double, -silent_ns / floor(x * 0.25)::double) end, 9) confidence from (select *, row_number() over (partition by subject order by silent_ns, last_seen desc, producer) rk from z) where rk = 1""",
    "q18_subgraph_deltas": _PIECES + f""", pc as (select * from ep where relation = 'scheduled_on'), nu as (select subject, row_number() over (order by source, target, relation) - 1 element from (select distinct subject, source, target, relation from pc)),
o as (select pc.*, element, coalesce(lag(end_source) over (partition by pc.subject order by "start"), 'not_seen_in_window') bf from pc join nu on pc.subject = nu.subject)
select "start" - {FROM} "at", element, true appear, bf reason from o where "start" > {FROM} union all select "end" - {FROM}, element, false, end_source from o where "end" < {TO}""",
    "q21_without": _PIECES + " select subject, \"start\", \"end\" from ep where relation = 'scheduled_on' and target <> 'k8s.node:3'",
    "sc14_backup_classes": f"with {_A} select case when subject_kind = 'entity' and source like 'host:%' then 'hosts' else lower(layer) end \"class\", count(*) records, max(seq) max_seq from a group by 1",
    "sc16_retirable": f"""with {_SVC}, k as (select *, case when subject_kind = 'entity' and source like 'host:%' then 'hosts' else lower(layer) end c, from a),
n as (select *, ntile(8) over (partition by c order by seq) f from k), r as (select c, f, max(event_time_ns) reach, min(event_time_ns) fo from n group by c, f),
w as (select *, min((reach <= {820454400000000000 - 2592000000000000})::int) over (partition by c order by f) ok, max(reach) over (partition by c order by f) rm, min(fo) over (partition by c order by f rows between 1 following and unbounded following) lf from r),
x as (select *, max(case when ok = 1 and (lf is null or rm <= lf) then f end) over (partition by c) la from w)
select c "class", f file, coalesce(f <= la, false) and c not in ('l0', 'hosts') retire from x""",
    "q24_case_scores": f"with {_A}, " + _latest("l1", "(select * from a where relation = 'scheduled_on')", T - 5 * 86400 * q.SECOND) + ", " + _latest("l2", "(select * from a where relation = 'scheduled_on')", T) + f""", pr as (select distinct target c, source e from l1 where {_live(T - 5 * 86400 * q.SECOND)}), tr as (select distinct target c, source e from l2 where {_live(T)}),
bo as (select coalesce(pr.c, tr.c) c, pr.e said, tr.e is_true, case when pr.e is not null then row_number() over (partition by coalesce(pr.c, tr.c) order by pr.e nulls last) end place from pr full join tr on pr.c = tr.c and pr.e = tr.e)
select c "case", count(said) n, count(case when said is not null and is_true is not null then 1 end) hits, count(is_true) truth, count(case when place <= 1 and is_true is not null then 1 end) hits_at_1, count(case when place <= 3 and is_true is not null then 1 end) hits_at_3, count(case when place <= 5 and is_true is not null then 1 end) hits_at_5 from bo group by 1""",
    "sc19_list_entities": f"with {_A} select distinct source entity from a where subject_kind = 'entity' and source like 'k8s.pod:%' and source > 'k8s.pod:3' order by 1 limit 50",
    "rt1_retain": f"with {_A}, " + _latest("le", "(select * from a where layer = 'L2')", FROM - 1) + f" select seq, layer, octet_length(encode(payload)) payload_bytes from a where layer <> 'L2' or event_time_ns >= {FROM} union all select seq, layer, null from le where {_live(FROM)}",
    "sf1_fingerprints": f"select c_custkey, 'host:' || substr(sha256(from_hex('{(NAMESPACE.encode() + bytes([1, 0, 0, 0, 4]) + b'host' + bytes([0, 0, 0, 1, 0, 0, 0, 7]) + b'host.id' + bytes([1])).hex()}') || from_hex(format('{{:08x}}', octet_length(encode(c_name)))) || encode(c_name)), 1, 32) fingerprint from customer",
}
