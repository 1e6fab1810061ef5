"""Service context: a service's callers and callees, their pods, and the services that shared a pod, node or host with them.

Set-wise over any number of services and seed pods: one plan, no loop over pods.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions.text import ratio_reached
from strandlog.operators import log as reads, ranges, spans
from strandlog.plans import coresidency
from strandlog.plans.coresidency import Caps, by_id
from strandlog.staging import staged

PAIR = ["service", "member", "peer", "mechanism"]


@dataclass(frozen=True)
class Limits:
    """What an answer lists at most, per service; None lists all.  What is cut is counted."""

    members: int | None = 16
    instances: int | None = 64
    seed_pods: int | None = 64
    pairs: int | None = 4096


@dataclass
class Context:
    """members: (service, member, role, rank, duration_ns); seed_pods: (service, pod, member, place, duration_ns);
    pairs: (PAIR, duration_ns, place); vias: (PAIR, via, start, end); contributions: (PAIR, via, pod, peer_pod, start, end);
    unmapped: (service, pod, start, end); unattributed: (instance, reason, start, end); suppressed: (service, peer, covered, frontier);
    dropped: (service, what, dropped).
    """

    members: DataFrame
    seed_pods: DataFrame
    pairs: DataFrame
    vias: DataFrame
    contributions: DataFrame
    unmapped: DataFrame
    unattributed: DataFrame
    suppressed: DataFrame
    dropped: DataFrame


def _dropped(counts: DataFrame, what: str, by: str = "service") -> DataFrame:
    return counts.filter("dropped > 0").groupBy(by).agg(F.sum("dropped").cast("long").alias("dropped")).select(F.col(by).alias("service"), F.lit(what).alias("what"), "dropped")


def _capped(df: DataFrame, cap: int | None, order: list, by: list[str]) -> tuple[DataFrame, DataFrame]:
    if cap is None:
        return reads.ranked(df, order, by), df.select(*by).limit(0).withColumn("dropped", F.lit(0).cast("long"))
    return reads.capped(df, cap, order, by)


def members(pieces: DataFrame, services: DataFrame, cap: int | None = 16) -> tuple[DataFrame, DataFrame]:
    """(service, member, role, rank, duration_ns): the service (role 0, rank 0), its callers (1) and callees (2; 3 for both) by shared time; self-calls do not count."""
    calls = pieces.filter("relation = 'depends_on' and source <> target").select("source", "target", "start", "end")
    s = services.select(F.col("entity").alias("service")).distinct()
    callers = calls.join(s, F.col("target") == F.col("service")).select("service", F.col("source").alias("member"), F.lit(1).alias("bit"), "start", "end")
    callees = calls.join(s, F.col("source") == F.col("service")).select("service", F.col("target").alias("member"), F.lit(2).alias("bit"), "start", "end")
    both = callers.unionByName(callees)
    roles = both.groupBy("service", "member").agg(F.bit_or("bit").alias("role"))
    time = spans.duration(spans.union_spans(both.select("service", "member", "start", "end"), ["service", "member"]), ["service", "member"])
    first, counts = _capped(roles.join(time, ["service", "member"]), None if cap is None else cap - 1, [F.desc("duration_ns"), *by_id("member")], ["service"])
    own = s.select("service", F.col("service").alias("member"), F.lit(0).alias("role"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("duration_ns"))
    return first.select("service", "member", "role", F.col("place").alias("rank"), "duration_ns").unionByName(own), counts


def mapping(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((instance, pod, service, start, end), (instance, reason, start, end)): instances alone in a pod and alone of a service, and where they are not."""
    pods = pieces.filter("relation = 'part_of' and source like 'service.instance:%'").select(F.col("source").alias("instance"), F.col("target").alias("pod"), "start", "end")
    svcs = pieces.filter("relation = 'instance_of'").select(F.col("source").alias("instance"), F.col("target").alias("service"), "start", "end")
    single = spans.intersect(spans.single_claim(pods, ["instance"], "pod"), spans.single_claim(svcs, ["instance"], "service"), ["instance"])
    several = [spans.ambiguous(x, ["instance"], t).select("instance", F.lit(f"several_{t}s").alias("reason"), "start", "end") for x, t in ((pods, "pod"), (svcs, "service"))]
    return single.select("instance", "pod", "service", "start", "end"), several[0].unionByName(several[1])


def ubiquitous(covered: DataFrame, frontier: DataFrame, by: list[str], numerator: int = 4, denominator: int = 5, min_nodes: int = 5) -> DataFrame:
    """(by, peer, covered, frontier): peers seen on at least numerator/denominator of a frontier of ``min_nodes`` nodes or more.

    ``covered``: (by, peer, node); ``frontier``: (by, node).
    """
    size = frontier.groupBy(*by).agg(F.count_distinct("node").alias("frontier"))
    seen = covered.join(frontier.select(*by, "node").distinct(), [*by, "node"], "left_semi").groupBy(*by, "peer").agg(F.count_distinct("node").alias("covered"))
    both = seen.join(size, by)
    return both.filter((F.col("frontier") >= min_nodes) & ratio_reached(F.col("covered"), F.col("frontier"), numerator, denominator)).select(*by, "peer", "covered", "frontier")


def unmapped(entries: DataFrame, mapped: DataFrame, by: list[str]) -> DataFrame:
    """(by, pod, start, end): spans of pods (by, pod, start, end) in which no instance maps them to a service."""
    keys = entries.select(*by, "pod").distinct()
    held = mapped.select("pod", "start", "end").join(keys, "pod").select(*by, "pod", "start", "end")
    return spans.subtract(entries, held, [*by, "pod"])


@dataclass
class Seeds:
    """What the places of a service's pods are looked for with: all of it grows with the log, not with pairs of pods."""

    known: DataFrame
    pieces: DataFrame
    members: DataFrame
    mapped: DataFrame
    unattributed: DataFrame
    useful: DataFrame
    pods: DataFrame
    cuts: list[tuple[DataFrame, str]]

    def met(self, from_ns: int, to_ns: int, caps: Caps) -> coresidency.Answer:
        return coresidency.find(self.known, self.pods.select(F.col("pod").alias("entity")), from_ns, to_ns, caps=caps, pieces=self.pieces)


def seeds(log: DataFrame, services: DataFrame, from_ns: int, to_ns: int, token: int | None = None, limits: Limits = Limits()) -> Seeds:
    """The members of the services (entity), their instances, and the pods of these."""
    known = reads.visible(log, token)
    every = staged(ranges.edge_pieces(known, from_ns, to_ns), "pieces")
    sound = every.filter("not uncascaded")
    who, cut_members = members(sound, services, limits.members)
    who = staged(who, "members")
    mapped, unattributed = mapping(sound)
    mapped = staged(mapped, "mapped")
    # The instances of members, those that were theirs longest first.
    own = sound.filter("relation = 'instance_of'").select(F.col("source").alias("instance"), F.col("target").alias("member"), "start", "end")
    own = spans.duration(own, ["instance", "member"]).join(who.select("service", "member", "rank"), "member")
    kept, cut_instances = _capped(own, limits.instances, [F.desc("duration_ns"), *by_id("instance")], ["service", "member"])
    useful = mapped.withColumnRenamed("service", "member").join(kept.select("service", "member", "instance", "rank"), ["member", "instance"])
    useful = staged(useful.select("service", "member", "rank", "instance", "pod", "start", "end"), "useful")
    best = useful.groupBy("service", "pod").agg(F.min(F.struct("rank", "member")).alias("b")).select("service", "pod", F.col("b.rank").alias("rank"), F.col("b.member").alias("member"))
    time = spans.duration(spans.union_spans(useful.join(best, ["service", "pod", "rank", "member"], "left_semi").select("service", "pod", "start", "end"), ["service", "pod"]), ["service", "pod"])
    pods, cut_pods = _capped(best.join(time, ["service", "pod"]), limits.seed_pods, ["rank", F.desc("duration_ns"), *by_id("pod")], ["service"])
    pods = staged(pods.select("service", "pod", "member", "rank", "duration_ns", "place"), "seed-pods")
    return Seeds(known, every, who, mapped, unattributed, useful, pods, [(cut_members, "members"), (cut_instances, "instances"), (cut_pods, "seed_pods")])


def extract(log: DataFrame, services: DataFrame, from_ns: int, to_ns: int, token: int | None = None, limits: Limits = Limits(), caps: Caps = Caps(), suppress: bool = True) -> Context:
    """The context of the services (entity): one depends_on hop, and whom its pods shared a place with."""
    own = seeds(log, services, from_ns, to_ns, token, limits)
    met = own.met(from_ns, to_ns, caps)
    overlaps = staged(met.overlaps, "overlaps")
    return _context(own.members, own.pods, own.useful, own.mapped, own.unattributed, met, overlaps, limits, suppress, own.cuts)


def unmapped_pods(log: DataFrame, services: DataFrame, from_ns: int, to_ns: int, token: int | None = None, limits: Limits = Limits(), caps: Caps = Caps()) -> DataFrame:
    """The ``unmapped`` of a context, without the pairs of services, which grow with the pairs of a pod's instances."""
    own = seeds(log, services, from_ns, to_ns, token, limits)
    return _unmapped(own.met(from_ns, to_ns, caps).overlaps, own.pods, own.mapped)


def _unmapped(overlaps: DataFrame, pods: DataFrame, mapped: DataFrame) -> DataFrame:
    entries = overlaps.select(F.col("seed").alias("pod"), F.col("peer").alias("peer_pod"), "start", "end").join(pods.select("service", "pod"), "pod")
    entries = spans.union_spans(entries.select("service", F.col("peer_pod").alias("pod"), "start", "end"), ["service", "pod"])
    return unmapped(entries, mapped, ["service"])


def _context(who, pods, useful, mapped, unattributed, met, overlaps, limits, suppress, cuts) -> Context:
    m = useful.join(pods.select("service", "pod"), ["service", "pod"], "left_semi").select("service", "member", F.col("instance").alias("m_instance"), "pod", "start", "end")
    other = mapped.select("pod", F.col("service").alias("peer"), F.col("instance").alias("p_instance"), "start", "end")
    same = spans.intersect(m, other, ["pod"]).filter("member <> peer and m_instance <> p_instance")
    by_pod = same.select("service", "member", "peer", F.lit("shared_pod").alias("mechanism"), F.col("pod").alias("via"), "pod", F.col("pod").alias("peer_pod"), "start", "end")
    # The union of a side's instances per pod before pods meet: rows grow with services on a pod, not with its instances.
    mine = spans.union_spans(m.select("service", "member", "pod", "start", "end"), ["service", "member", "pod"])
    theirs = spans.union_spans(other.select("peer", F.col("pod").alias("peer_pod"), "start", "end"), ["peer", "peer_pod"])
    placed = spans.intersect(mine, overlaps.select(F.col("seed").alias("pod"), F.col("peer").alias("peer_pod"), "mechanism", "via", "start", "end"), ["pod"])
    by_place = spans.intersect(placed, theirs, ["peer_pod"]).filter("member <> peer").select(*by_pod.columns)
    found = by_pod.unionByName(by_place)
    listed = who.select("service", F.col("member").alias("peer"), F.lit(True).alias("_both"))
    found = found.join(listed, ["service", "peer"], "left")
    swap = F.coalesce("_both", F.lit(False)) & (F.col("peer") < F.col("member"))
    turned = {"member": ("peer", "member"), "peer": ("member", "peer"), "pod": ("peer_pod", "pod"), "peer_pod": ("pod", "peer_pod")}
    found = found.select("service", *[F.when(swap, F.col(a)).otherwise(F.col(b)).alias(n) for n, (a, b) in turned.items()], "mechanism", "via", "start", "end", (~F.coalesce("_both", F.lit(False))).alias("outside"))
    found = staged(found, "contributions")
    frontier = met.alone.filter("child like 'k8s.pod:%'").select(F.col("child").alias("pod"), F.col("parent").alias("node")).join(pods.select("service", "pod"), "pod").select("service", "node").distinct()
    covered = found.filter("outside and mechanism = 'shared_node'").select("service", "peer", F.col("via").alias("node")).distinct()
    common = staged(ubiquitous(covered, frontier, ["service"]), "ubiquitous")
    if suppress:
        found = found.join(common.select("service", "peer"), ["service", "peer"], "left_anti")
    contributions = spans.union_spans(found.select(*PAIR, "via", "pod", "peer_pod", "start", "end"), [*PAIR, "via", "pod", "peer_pod"])
    vias = spans.union_spans(found.select(*PAIR, "via", "start", "end"), [*PAIR, "via"])
    pairs = spans.duration(spans.union_spans(found.select(*PAIR, "start", "end"), PAIR), PAIR)
    ranks = who.groupBy("service", "member").agg(F.min("rank").alias("_rank"))
    of_peer = ranks.select("service", F.col("member").alias("peer"), F.col("_rank").alias("_peer_rank"))
    pairs = pairs.join(ranks, ["service", "member"], "left").join(of_peer, ["service", "peer"], "left")
    pairs = pairs.withColumn("_best", F.least("_rank", "_peer_rank")).withColumn("_kind", F.when(F.col("mechanism") == "shared_pod", 0).when(F.col("mechanism") == "shared_node", 1).otherwise(2))
    first, cut_pairs = _capped(pairs, limits.pairs, [F.desc("duration_ns"), "_kind", "_best", *by_id("peer"), *by_id("member")], ["service"])
    dropped = _dropped(cut_pairs, "pairs")
    for counts, what in cuts:
        dropped = dropped.unionByName(_dropped(counts, what))
    return Context(who, pods, first.select(*PAIR, "duration_ns", "place"), vias, contributions, _unmapped(overlaps, pods, mapped), unattributed, common, dropped)


def anchored(log: DataFrame, service: str, host: str, t: int, from_ns: int, to_ns: int, token: int | None = None, caps: Caps = Caps()) -> tuple[str, DataFrame, Context | None]:
    """(state, confirmed pods (service, member, pod), context): the context of the pods that a service and its neighbours had on a host at an instant.

    state: ``on_host``; ``not_on_host`` if no pod of the service was on a node of the host then; ``host_unattributed``
    if one was, but none whose host is known for certain: then nothing is expanded.
    """
    known = reads.visible(log, token)
    spark = log.sparkSession
    every = staged(ranges.edge_pieces(known, from_ns, to_ns), "pieces")
    now = spans.at(every, t)
    nodes = now.filter((F.col("relation") == "runs_on") & (F.col("target") == host)).select(F.col("source").alias("node"))
    pods = now.filter("relation = 'scheduled_on'").select(F.col("source").alias("pod"), F.col("target").alias("node")).join(nodes, "node", "left_semi").select("pod").distinct()
    asked = spark.createDataFrame([(service,)], "entity string")
    who, _ = members(every.filter("not uncascaded"), asked)
    who = staged(who, "members")
    mapped, unattributed = mapping(every.filter("not uncascaded"))
    mapped = staged(mapped, "mapped")
    candidates = spans.at(mapped, t).withColumnRenamed("service", "member").join(who.select("service", "member", "rank"), "member").join(pods, "pod", "left_semi")
    candidates = staged(candidates.select("service", "member", "rank", "pod").distinct(), "candidates")
    if not candidates.filter(F.col("member") == service).limit(1).count():
        return "not_on_host", candidates.limit(0).drop("rank"), None
    met = coresidency.find(known, candidates.select(F.col("pod").alias("entity")).distinct(), from_ns, to_ns, caps=caps, pieces=every)
    sure = spans.at(met.seed_hosts.filter(F.col("host") == host), t).select(F.col("seed").alias("pod")).distinct()
    confirmed = staged(candidates.join(sure, "pod", "left_semi"), "confirmed")
    if not confirmed.filter(F.col("member") == service).limit(1).count():
        return "host_unattributed", confirmed.limit(0).drop("rank"), None
    useful = mapped.withColumnRenamed("service", "member").join(confirmed, ["member", "pod"]).select("service", "member", "rank", "instance", "pod", "start", "end")
    best = confirmed.groupBy("service", "pod").agg(F.min(F.struct("rank", "member")).alias("b")).select("service", "pod", F.col("b.rank").alias("rank"), F.col("b.member").alias("member"))
    time = spans.duration(spans.union_spans(useful.select("service", "pod", "start", "end"), ["service", "pod"]), ["service", "pod"])
    listed = staged(reads.ranked(best.join(time, ["service", "pod"]), ["rank", F.desc("duration_ns"), *by_id("pod")], ["service"]), "seed-pods")
    overlaps = staged(met.overlaps.join(listed.select(F.col("pod").alias("seed")), "seed", "left_semi"), "overlaps")
    context = _context(who, listed, staged(useful, "useful"), mapped, unattributed, met, overlaps, Limits(), False, [])
    return "on_host", confirmed.drop("rank"), context
