"""Co-residency of pods: who shared a node, or a host through two nodes, with what the caps left out.

All questions are set-wise: ``seeds`` may be one pod or many, and every answer carries its seed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.operators import log as reads, ranges, spans
from strandlog.schema import hash_of, type_of
from strandlog.staging import staged

SECOND = 1_000_000_000
ENTRY = ["seed", "mechanism", "peer", "node", "peer_node", "via"]
LEG = ["seed", "mechanism", "node", "peer_node", "via"]
CARRIED = 1 << 20  #: ends of legs that are looked up by a broadcast, if no more
PART = 1024  #: spans of peers on a node, and of legs to it, that one call compares


@dataclass(frozen=True)
class Caps:
    """What one seed's answer lists at most; None lists all.  What is cut is counted."""

    nodes: int | None = 64
    hosts: int | None = 16
    per_via: int | None = 1024
    results: int | None = 4096


@dataclass
class Answer:
    """entries: (ENTRY, duration_ns, n_spans, place), kept and ranked; overlaps: (ENTRY, start, end) of them;
    suppressed: entries below the least overlap; seed_hosts: (seed, node, host, start, end);
    unattributed: (seed, subject, reason, start, end); dropped: (seed, what, via, mechanism, dropped);
    pieces: the edge pieces that all is derived from; alone: (child, parent, start, end) of single claims.

    The overlaps, of which there are most, are made when something is asked that needs them.
    """

    seed_hosts: DataFrame
    unattributed: DataFrame
    pieces: DataFrame
    alone: DataFrame
    meet: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]
    hold: Callable[[Callable[[], DataFrame]], DataFrame]

    @cached_property
    def _met(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.meet()

    @cached_property
    def overlaps(self) -> DataFrame:
        return self.hold(lambda: self.entries)

    entries = property(lambda self: self._met[0])
    suppressed = property(lambda self: self._met[1])
    dropped = property(lambda self: self._met[2])


def by_id(column: str) -> list:
    return [type_of(F.col(column)), hash_of(F.col(column))]


def rank_order() -> list:
    """Duration, then shared node before shared host, then peer, nodes and via."""
    return [F.desc("duration_ns"), F.desc("mechanism"), *by_id("peer"), *by_id("node"), *by_id("peer_node"), *by_id("via")]


def _limited(df: DataFrame, cap: int | None, by: list[str], what: str, target: str) -> tuple[DataFrame, DataFrame]:
    """The ``cap`` targets of each group with the longest time, and how many were cut."""
    size = spans.duration(df, [*by, target])
    none = df.sparkSession.createDataFrame([], "seed string, what string, via string, mechanism string, dropped long")
    if cap is None:
        return df, none
    first, counts = reads.capped(size, cap, [F.desc("duration_ns"), *by_id(target)], by)
    cut = counts.filter("dropped > 0").select(*by, F.lit(what).alias("what"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("mechanism"), F.col("dropped").cast("long"))
    return df.join(first.select(*by, target), [*by, target], "left_semi"), cut


def _pairs(legs: DataFrame, peers: DataFrame) -> Callable[..., DataFrame]:
    """Entries of the legs (LEG, start, end) and the peers (peer, peer_node, start, end), made where both are: no row of a pair is shuffled.

    The peers of a node and the legs to it are dealt over parts of about ``PART`` spans each, and every two parts meet in one call,
    so what a call holds does not grow with the seeds or the peers.
    """
    legs = staged(spans.union_spans(legs, LEG), "ways")
    own = spans.union_spans(peers, ["peer", "peer_node"])
    own = staged(own.join(F.broadcast(legs.select("peer_node").distinct()), "peer_node", "left_semi"), "peers")  # nodes of seeds' hosts
    parts = own.groupBy("peer_node").agg((F.count(F.lit(1)) / PART).cast("long").alias("parts"))
    ways_parts = legs.groupBy("peer_node").agg((F.count(F.lit(1)) / PART).cast("long").alias("ways"))
    both = parts.join(ways_parts, "peer_node")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    spread = own.join(both, "peer_node").withColumn("way", every("ways"))
    spread = spread.select("peer_node", F.pmod(F.xxhash64("peer"), F.col("parts") + 1).alias("part"), "way", "peer", *[x.alias(n) for x, n in zip(by_id("peer"), ("type", "hash"))], "start", "end")
    sent = legs.join(both, "peer_node").withColumn("part", every("parts")).select("part", F.pmod(F.xxhash64(*LEG), F.col("ways") + 1).alias("way"), *LEG, "start", "end")

    def pair(from_ns: int, to_ns: int, least: int, cap: int | None, short: bool = False, whole: bool = False) -> DataFrame:
        """(ENTRY, duration_ns, n_spans, n_kept): entries of at least ``least`` or at an edge of the window, or with ``short`` the others.

        With ``cap`` only the longest of each leg and part; n_kept, on one of its rows, counts all of them.
        With ``whole`` the spans (ENTRY, start, end) of the entries: those of a leg and of a peer are maximal, so what they share is too.
        """

        def run(ways: pa.Table, there: pa.Table) -> pa.Table:
            there = there.sort_by([("type", "ascending"), ("hash", "ascending"), ("start", "ascending")])
            names = there["peer"].to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
            heads = names[first]
            start, end = there["start"].to_numpy(), there["end"].to_numpy()
            ways = ways.sort_by([(c, "ascending") for c in LEG])
            rows = list(zip(*(ways[c].to_pylist() for c in LEG)))
            a, b = ways["start"].to_numpy(), ways["end"].to_numpy()
            size = np.diff(np.append(first, len(names)))
            edges = [i for i in range(len(rows)) if not i or rows[i] != rows[i - 1]] if len(first) else []
            made, held_spans = [], []
            for i, j in zip(edges, [*edges[1:], len(rows)]):
                time, n, edge = (np.zeros(len(first), np.int64) for _ in range(3))
                for k in range(i, j):
                    low, high = np.maximum(start, a[k]), np.minimum(end, b[k])
                    held = high > low
                    time += np.add.reduceat(np.where(held, high - low, 0), first)
                    n += np.add.reduceat(held.astype(np.int64), first)
                    edge += np.add.reduceat((held & ((low == from_ns) | (high == to_ns))).astype(np.int64), first)
                long_enough = (time >= least) | (edge > 0)
                at = np.flatnonzero((n > 0) & (long_enough != short) & (heads != rows[i][0]))
                if whole:
                    kept = np.zeros(len(first), bool)
                    kept[at] = True
                    spread_out = np.repeat(kept, size)
                    for k in range(i, j):
                        low, high = np.maximum(start, a[k]), np.minimum(end, b[k])
                        there_at = np.flatnonzero(spread_out & (high > low))
                        held_spans.append((np.full(len(there_at), i), there_at, low[there_at], high[there_at]))
                    continue
                total = len(at)
                if cap is not None and total > cap:
                    at = at[np.argsort(-time[at], kind="stable")[:cap]]  # peers are in the order of their ids
                made.append((np.full(len(at), i), at, time[at], n[at], np.where(np.arange(len(at)) == 0, total, 0)))
            if whole:
                way, at, low, high = (np.concatenate(x) for x in zip(*held_spans)) if held_spans else [np.zeros(0, np.int64)] * 4
                told = {c: ways[c].combine_chunks().take(pa.array(way)) for c in LEG} | {"peer": there["peer"].combine_chunks().take(pa.array(at))}
                return pa.table({**{c: told[c] for c in ENTRY}, "start": low, "end": high})
            way, at, time, n, total = (np.concatenate(x) for x in zip(*made)) if made else [np.zeros(0, np.int64)] * 5
            told = {c: ways[c].combine_chunks().take(pa.array(way)) for c in LEG} | {"peer": there["peer"].combine_chunks().take(pa.array(first[at] if len(at) else at))}
            return pa.table({**{c: told[c] for c in ENTRY}, "duration_ns": time, "n_spans": n, "n_kept": total})

        types = ", ".join(f"{c} string" for c in ENTRY) + (", start long, end long" if whole else ", duration_ns long, n_spans long, n_kept long")
        return sent.groupBy("peer_node", "part", "way").cogroup(spread.groupBy("peer_node", "part", "way")).applyInArrow(run, types)

    return pair


def find(log: DataFrame, seeds: DataFrame, from_ns: int, to_ns: int, token: int | None = None, min_overlap_ns: int = SECOND, caps: Caps = Caps(), pieces: DataFrame | None = None) -> Answer:
    """Co-residents of the pods in ``seeds`` (entity).

    A seed's own node, and each node's host, count only while they are the only claim; a claim of a
    quarantined end counts as a claim and is not followed.  A peer's own ambiguity is not looked at.
    """
    known = reads.visible(log, token)
    every = pieces if pieces is not None else staged(ranges.edge_pieces(known, from_ns, to_ns), "pieces")
    e = every.filter("not uncascaded")
    wanted = seeds.select(F.col("entity").alias("seed")).distinct()
    placed = every.filter("relation = 'scheduled_on'").select(F.col("source").alias("pod"), F.col("target").alias("node"), "start", "end", "uncascaded")
    mine = placed.withColumnRenamed("pod", "seed").join(wanted, "seed", "left_semi")
    sound = placed.filter("not uncascaded").drop("uncascaded")
    alone = spans.single_claim(mine.drop("uncascaded"), ["seed"], "node").join(mine.filter("not uncascaded").select("seed", "node").distinct(), ["seed", "node"], "left_semi")
    alone, cut_nodes = _limited(staged(alone, "alone"), caps.nodes, ["seed"], "nodes", "node")
    claims = every.filter("relation = 'runs_on' and source like 'k8s.node:%'").select(F.col("source").alias("node"), F.col("target").alias("host"), "start", "end", "uncascaded")
    one = spans.single_claim(claims.drop("uncascaded"), ["node"], "host")
    bad = claims.filter("uncascaded").select("node", "host").distinct()
    on_host = staged(one.join(bad, ["node", "host"], "left_anti"), "hosts")
    seed_hosts = staged(spans.intersect(alone, on_host, ["node"]).select("seed", "node", "host", "start", "end"), "seed-hosts")
    kept_hosts, cut_hosts = _limited(seed_hosts, caps.hosts, ["seed"], "hosts", "host")

    def ways() -> tuple[DataFrame, DataFrame]:
        """(LEG, start, end) by which peers are met, and what a cap left out of them."""
        there = spans.intersect(kept_hosts, on_host.withColumnRenamed("node", "peer_node"), ["host"]).filter("node <> peer_node")
        if caps.nodes is not None:
            there, cut = _limited(there, caps.nodes, ["seed", "host"], "nodes_of_a_host", "peer_node")
            cut = cut.groupBy("seed", "what", "via", "mechanism").agg(F.sum("dropped").alias("dropped"))
        else:
            cut = cut_hosts.limit(0)
        own = alone.select("seed", F.lit("shared_node").alias("mechanism"), "node", F.col("node").alias("peer_node"), F.col("node").alias("via"), "start", "end")
        return own.unionByName(there.select("seed", F.lit("shared_host").alias("mechanism"), "node", "peer_node", F.col("host").alias("via"), "start", "end")), cut

    peers = sound.select(F.col("pod").alias("peer"), F.col("node").alias("peer_node"), "start", "end")

    paired = []

    def pairs() -> tuple[Callable[..., DataFrame], DataFrame]:
        if not paired:
            legs, cut = ways()
            paired.append((_pairs(legs, peers), cut))
        return paired[0]

    def meet() -> tuple[DataFrame, DataFrame, DataFrame]:
        pair, cut_others = pairs()
        dropped = cut_nodes.unionByName(cut_hosts).unionByName(cut_others)
        kept, short = pair(from_ns, to_ns, min_overlap_ns, caps.per_via), pair(from_ns, to_ns, min_overlap_ns, None, True)
        if caps.per_via is not None:
            kept = staged(kept, "within")
            within = ["seed", "mechanism", "via"]
            over = (F.sum("n_kept") - caps.per_via).cast("long")
            dropped = dropped.unionByName(kept.groupBy(*within).agg(over.alias("dropped")).filter("dropped > 0").select("seed", F.lit("per_via").alias("what"), "via", "mechanism", "dropped"))
            kept = staged(reads.ranked(kept, rank_order(), within).filter(F.col("place") <= caps.per_via).drop("place"), "within")
        kept = kept.drop("n_kept")
        if caps.results is not None:
            kept, over = reads.capped(kept, caps.results, rank_order(), ["seed"])
            kept = kept.drop("place")
            dropped = dropped.unionByName(over.filter("dropped > 0").select("seed", F.lit("results").alias("what"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("mechanism"), F.col("dropped").cast("long")))
        return reads.ranked(kept, rank_order(), ["seed"]), reads.ranked(short.drop("n_kept"), rank_order(), ["seed"]), dropped

    def hold(entries: Callable[[], DataFrame]) -> DataFrame:
        runs = staged(pairs()[0](from_ns, to_ns, min_overlap_ns, None, whole=True), "overlaps")
        return runs if caps.per_via is None and caps.results is None else runs.join(entries().select(*ENTRY), ENTRY, "left_semi")

    several = spans.ambiguous(mine.drop("uncascaded"), ["seed"], "node").select("seed", F.col("seed").alias("subject"), F.lit("several_nodes").alias("reason"), "start", "end")
    claimed = spans.intersect(alone, claims.drop("uncascaded"), ["node"]).select("seed", "node", "start", "end")
    none = spans.subtract(alone.select("seed", "node", "start", "end"), claimed, ["seed", "node"]).withColumn("reason", F.lit("no_host"))
    many = spans.intersect(alone, spans.ambiguous(claims.drop("uncascaded"), ["node"], "host"), ["node"]).withColumn("reason", F.lit("several_hosts"))
    only_bad = spans.intersect(alone, one.join(bad, ["node", "host"], "left_semi"), ["node"]).withColumn("reason", F.lit("quarantined_host"))
    nodes = [x.select("seed", F.col("node").alias("subject"), "reason", "start", "end") for x in (none, many, only_bad)]
    unplaced = spans.union_spans(several.unionByName(nodes[0]).unionByName(nodes[1]).unionByName(nodes[2]), ["seed", "subject", "reason"])
    single = alone.select(F.col("seed").alias("child"), F.col("node").alias("parent"), "start", "end").unionByName(on_host.select(F.col("node").alias("child"), F.col("host").alias("parent"), "start", "end"))
    return Answer(seed_hosts, unplaced, e, single, meet, hold)


#: The legs of an entry: name, child column, parent column, whether the child must be there alone.
LEGS = {
    "shared_node": [("seed_on_node", "seed", "via", True), ("peer_on_node", "peer", "via", False)],
    "shared_host": [("seed_on_node", "seed", "node", True), ("node_on_host", "node", "via", True), ("peer_node_on_host", "peer_node", "via", True), ("peer_on_node", "peer", "peer_node", False)],
}


def leg_ends(answer: Answer) -> DataFrame:
    """(child, parent, single, at, reason): the instants at which a leg can end an overlap, one that has to be alone there (``single``) or not; as many as pieces."""
    pieces = answer.pieces.select(F.col("source").alias("child"), F.col("target").alias("parent"), F.col("start").alias("_s"), F.col("end").alias("_e"), "end_source")
    plain = pieces.select("child", "parent", F.lit(False).alias("single"), F.col("_e").alias("at"), F.col("end_source").alias("reason"))
    both = pieces.join(answer.alone.select("child", "parent", F.col("start").alias("_as"), F.col("end").alias("_ae")), ["child", "parent"]).filter((F.col("_s") < F.col("_ae")) & (F.col("_as") < F.col("_e")))
    both = both.withColumn("at", F.explode(F.array_distinct(F.array("_e", "_ae")))).filter((F.col("at") > F.greatest("_s", "_as")) & (F.col("at") <= F.least("_e", "_ae")))
    alone = both.select("child", "parent", F.lit(True).alias("single"), "at", F.when(F.col("_e") == F.col("at"), F.col("end_source")).otherwise("unattributed").alias("reason"))
    return plain.unionByName(alone).distinct()


def ends(answer: Answer, to_ns: int) -> DataFrame:
    """(ENTRY, start, end, leg, reason): for each overlap that ends in the window the legs that end it, and why.

    A leg whose piece ends there gives its reason; one that is no longer alone there, though its piece goes
    on, is unattributed.  Overlaps are gone through once and are no more dealt than the legs' ends need.
    """
    own = {m: F.array(*[F.struct(F.lit(n).alias("leg"), F.col(c).alias("child"), F.col(p).alias("parent"), F.lit(single).alias("single")) for n, c, p, single in legs]) for m, legs in LEGS.items()}
    legs = F.when(F.col("mechanism") == "shared_node", own["shared_node"]).otherwise(own["shared_host"])
    x = answer.overlaps.filter(F.col("end") < to_ns).select(*ENTRY, "start", "end", F.explode(legs).alias("_leg")).select(*ENTRY, "start", "end", "_leg.*")
    told = staged(leg_ends(answer), "leg-ends")
    if told.count() <= CARRIED:
        told = F.broadcast(told)
    return x.join(told.withColumnRenamed("at", "end"), ["child", "parent", "single", "end"]).select(*ENTRY, "start", "end", "leg", "reason")
