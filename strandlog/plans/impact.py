"""Blast radius: what a failing entity reaches over chains of edges that all exist at once, and what the caps left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog import schema
from strandlog.operators import log as reads, ranges, spans
from strandlog.plans.coresidency import by_id
from strandlog.schema import type_of
from strandlog.staging import staged


@dataclass
class Reach:
    """spans: (seed, member, depth, start, end), maximal, with the first depth; arrivals: (seed, member, parent, relation, start, end);
    members: (seed, member, depth, duration_ns, class, transitions, place), ranked; unattributed: (seed, subject, relation, target_type, start, end);
    truncated: (seed, what, depth, entity, dropped): entities not expanded (entity set), and members not listed (dropped set).
    """

    spans: DataFrame
    arrivals: DataFrame
    members: DataFrame
    unattributed: DataFrame
    truncated: DataFrame


def legs(log: DataFrame, from_ns: int, to_ns: int, pieces: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((child, parent, relation, start, end), (child, relation, kind, start, end)): edges along which failure travels, and ambiguous placements.

    runs_on and located_in count only while they are the only claim of their relation and type; claims with a
    quarantined end count as claims and are not followed.
    """
    moving = F.broadcast(schema.relations(log.sparkSession).filter("propagation <> 'none'").select("relation").distinct())  # a handful of names
    e = (pieces if pieces is not None else ranges.edge_pieces(log, from_ns, to_ns)).join(moving, "relation", "left_semi")
    e = e.select(F.col("source").alias("child"), F.col("target").alias("parent"), "relation", "start", "end", "uncascaded")
    single = F.col("relation").isin(*schema.SINGLE_CLAIM)
    one = e.filter(single).withColumn("kind", type_of(F.col("parent")))
    alone = spans.single_claim(one.drop("uncascaded"), ["child", "relation", "kind"], "parent")
    bad = one.filter("uncascaded").select("child", "relation", "parent").distinct()
    alone = alone.join(bad, ["child", "relation", "parent"], "left_anti").select("child", "parent", "relation", "start", "end")
    free = e.filter(~single & ~F.col("uncascaded")).select("child", "parent", "relation", "start", "end")
    return free.unionByName(alone), spans.ambiguous(one.drop("uncascaded"), ["child", "relation", "kind"], "parent")


def expandable():
    """Entities of a type that some relation reaches in reverse."""
    return type_of(F.col("member")).isin(sorted({r[2] for r in schema.RELATIONS}))


def walk(log: DataFrame, seeds: DataFrame, from_ns: int, to_ns: int, token: int | None = None, max_depth: int = 6, max_frontier: int | None = 1024, max_members: int | None = 4096, excluded: DataFrame | None = None) -> Reach:
    """The reach of every seed (entity, with optional start and end).

    Reach is carried as spans along paths, never over a union of edges.  Per depth one overlap join; the
    state is written between depths, so a lost executor costs one depth at most.  A seed is never a member.
    ``excluded``: (member) not followed.
    """
    spark = log.sparkSession
    known = reads.visible(log, token)
    moving, open_claims = legs(known, from_ns, to_ns)
    moving, open_claims = staged(moving, "legs"), staged(open_claims, "ambiguous")
    if excluded is not None:
        moving = moving.join(excluded.select(F.col("member").alias("child")).distinct(), "child", "left_anti")
    start = seeds if "start" in seeds.columns else seeds.select("entity", F.lit(from_ns).alias("start"), F.lit(to_ns).alias("end"))
    delta = start.select(F.col("entity").alias("seed"), F.col("entity").alias("member"), "start", "end")
    reach, arrivals, cut = None, None, spark.createDataFrame([], "seed string, what string, depth int, entity string, dropped long")
    deltas = delta
    for depth in range(1, max_depth + 1):
        found = spans.intersect(delta.withColumnRenamed("member", "parent"), moving, ["parent"]).filter("child <> seed")
        found = staged(found.select("seed", F.col("child").alias("member"), "parent", "relation", "start", "end"), "arrivals")
        gained = spans.union_spans(found.select("seed", "member", "start", "end"), ["seed", "member"])
        grown = spans.subtract(gained, reach, ["seed", "member"]) if reach is not None else gained
        grown = staged(grown.select("seed", "member", "start", "end", F.lit(depth).alias("depth")), "reach")
        if not grown.limit(1).count():
            break
        reach = grown if reach is None else reach.unionByName(grown)
        arrivals = found if arrivals is None else arrivals.unionByName(found)
        delta = grown.drop("depth").filter(expandable())
        if depth == max_depth:
            left = delta.select("seed", F.lit("depth").alias("what"), F.lit(depth).alias("depth"), F.col("member").alias("entity"), F.lit(None).cast("long").alias("dropped")).distinct()
            cut = cut.unionByName(left)
        elif max_frontier is not None:
            ordered = reads.ranked(spans.duration(delta, ["seed", "member"]), [F.desc("duration_ns"), *by_id("member")], ["seed"])
            over = ordered.filter(F.col("place") > max_frontier)
            cut = cut.unionByName(over.select("seed", F.lit("frontier").alias("what"), F.lit(depth).alias("depth"), F.col("member").alias("entity"), F.lit(None).cast("long").alias("dropped")))
            delta = delta.join(over.select("seed", "member"), ["seed", "member"], "left_anti")
        deltas = deltas.unionByName(delta)
    if reach is None:
        reach = delta.limit(0).withColumn("depth", F.lit(0))
        arrivals = delta.limit(0).select("seed", "member", F.lit("").alias("parent"), F.lit("").alias("relation"), "start", "end")
    first = reach.groupBy("seed", "member").agg(F.min("depth").alias("depth"))
    whole = staged(spans.union_spans(reach.select("seed", "member", "start", "end"), ["seed", "member"]).join(first, ["seed", "member"]).select("seed", "member", "depth", "start", "end"), "reach")
    keyed = whole.withColumn("subject", F.concat_ws(" ", "seed", "member"))
    classes = ranges.classify(keyed, from_ns, to_ns).select("subject", "class", "transitions", "duration_ns")
    facts = keyed.select("seed", "member", "depth", "subject").distinct()
    order = ["depth", F.desc("duration_ns"), *by_id("member")]
    members = reads.ranked(facts.join(classes, "subject").drop("subject"), order, ["seed"])
    if max_members is not None:
        _, counts = reads.capped(members.drop("place"), max_members, order, ["seed"])
        over = counts.filter("dropped > 0").select("seed", F.lit("members").alias("what"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("entity"), F.col("dropped").cast("long"))
        members, cut = members.filter(F.col("place") <= max_members), cut.unionByName(over)
    # An ambiguous placement that the failure met: the claim overlaps the new reach of its own target.
    claims = ranges.edge_pieces(known, from_ns, to_ns).filter(F.col("relation").isin(*schema.SINGLE_CLAIM)).select(F.col("source").alias("child"), F.col("target").alias("parent"), "relation", "start", "end").withColumn("kind", type_of(F.col("parent")))
    met = spans.intersect(deltas.withColumnRenamed("member", "parent"), claims, ["parent"]).filter("child <> seed").select("seed", "child", "relation", "kind", "start", "end")
    unplaced = spans.intersect(met, open_claims, ["child", "relation", "kind"]).select("seed", F.col("child").alias("subject"), "relation", F.col("kind").alias("target_type"), "start", "end")
    unplaced = spans.union_spans(unplaced, ["seed", "subject", "relation", "target_type"])
    way = spans.union_spans(arrivals, ["seed", "member", "parent", "relation"])
    return Reach(whole, way, members, unplaced, cut)


def substrates(log: DataFrame, pods: DataFrame, from_ns: int, to_ns: int, max_depth: int = 6) -> DataFrame:
    """(pod, entity, depth, start, end): what each pod (entity) stood on, upward, with the times it did."""
    moving, _ = legs(log, from_ns, to_ns)
    moving = staged(moving, "legs")
    delta = pods.select(F.col("entity").alias("pod"), "entity", F.lit(from_ns).alias("start"), F.lit(to_ns).alias("end"))
    reach = None
    for depth in range(1, max_depth + 1):
        up = spans.intersect(delta.withColumnRenamed("entity", "child"), moving.drop("relation"), ["child"]).select("pod", F.col("parent").alias("entity"), "start", "end")
        gained = spans.union_spans(up, ["pod", "entity"])
        grown = spans.subtract(gained, reach, ["pod", "entity"]) if reach is not None else gained
        grown = staged(grown.select("pod", "entity", "start", "end", F.lit(depth).alias("depth")), "substrates")
        if not grown.limit(1).count():
            break
        reach = grown if reach is None else reach.unionByName(grown)
        delta = grown.drop("depth")
    if reach is None:
        return delta.limit(0).withColumn("depth", F.lit(0)).select("pod", "entity", "depth", "start", "end")
    first = reach.groupBy("pod", "entity").agg(F.min("depth").alias("depth"))
    return spans.union_spans(reach.select("pod", "entity", "start", "end"), ["pod", "entity"]).join(first, ["pod", "entity"]).select("pod", "entity", "depth", "start", "end")


#: Substrates that the walk goes back from; racks and zones are listed only, unless asked for.
WORKING = ("k8s.node", "host")


def around(log: DataFrame, pod: str, from_ns: int, to_ns: int, expand_fabric: bool = False, **caps) -> tuple[DataFrame, Reach]:
    """(substrates with place, reach of each from when the pod was on it, the pod left out)."""
    spark = log.sparkSession
    on = staged(substrates(log, spark.createDataFrame([(pod,)], "entity string"), from_ns, to_ns), "substrates")
    time = spans.duration(on, ["entity"]).join(on.select("entity", "depth").distinct(), "entity")
    listed = reads.ranked(time, ["depth", F.desc("duration_ns"), *by_id("entity")])
    fails = on if expand_fabric else on.filter(type_of(F.col("entity")).isin(*WORKING))
    reach = walk(log, fails.select("entity", "start", "end"), from_ns, to_ns, excluded=spark.createDataFrame([(pod,)], "member string"), **caps)
    return listed, reach
