"""Predicted sets scored against labelled truth: counts per case, pooled figures, bootstrap intervals.

Everything is an aggregate by case, so a case with very many predictions is combined before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators import log as reads, ranges
from strandlog.staging import staged

KS = (1, 3, 5)  #: cut-offs of the figures at k


def _ratio(a, b):
    return F.when(b > 0, a / b)


def case_scores(predictions: DataFrame, truth: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(case, n, hits, truth, hits_at_1, hits_at_3, hits_at_5, precision, recall, f1) per case of either side.

    ``predictions``: (case, entity, rank), an entity counted once, at its best rank; equal ranks go by entity.
    ``truth``: (case, entity).  ``skip``: (case, entity) left out of both sides, as the seeds are.
    A ratio with nothing below it is null.
    """
    named = predictions.filter("case is not null and entity is not null").groupBy("case", "entity").agg(F.min("rank").alias("rank"))
    real = truth.filter("case is not null and entity is not null").select("case", "entity").distinct()
    if skip is not None:
        named, real = named.join(skip, ["case", "entity"], "left_anti"), real.join(skip, ["case", "entity"], "left_anti")
    both = named.withColumn("said", F.lit(1)).join(real.withColumn("is_true", F.lit(1)), ["case", "entity"], "full")
    # Only the places up to the largest cut-off matter: Spark keeps that many rows of a case before the shuffle.
    order = Window.partitionBy("case").orderBy(F.col("rank").asc_nulls_last(), "entity")
    top = both.filter("said = 1").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(KS))
    at = top.groupBy("case").agg(*[F.count(F.when((F.col("place") <= k) & (F.col("is_true") == 1), 1)).alias(f"hits_at_{k}") for k in KS])
    counts = both.groupBy("case").agg(F.count("said").alias("n"), F.count(F.when((F.col("said") == 1) & (F.col("is_true") == 1), 1)).alias("hits"), F.count("is_true").alias("truth"))
    out = counts.join(at, "case", "left").fillna(0, [f"hits_at_{k}" for k in KS])
    return out.withColumns({"precision": _ratio(F.col("hits"), F.col("n")), "recall": _ratio(F.col("hits"), F.col("truth")), "f1": _ratio(2 * F.col("hits"), F.col("n") + F.col("truth"))})


def one_hop(log: DataFrame, seeds: DataFrame, t: int) -> DataFrame:
    """(case, entity): the baseline that names all that stands on a seed at an instant, and no more."""
    return reads.neighbors(log, seeds, t, "reverse").select(F.col("entity").alias("case"), F.col("peer").alias("entity")).distinct()


def union_graph(log: DataFrame, seeds: DataFrame, from_ns: int, to_ns: int, max_depth: int = 6) -> DataFrame:
    """(case, entity): the baseline that follows edges of the window as if all existed at once."""
    edges = staged(ranges.edge_pieces(log, from_ns, to_ns).select(F.col("source").alias("child"), F.col("target").alias("parent")).distinct(), "union")
    found = seeds.select(F.col("entity").alias("case"), "entity")
    reached = found
    for _ in range(max_depth):
        new = found.join(edges, found["entity"] == edges["parent"]).select("case", F.col("child").alias("entity")).distinct()
        found = staged(new.join(reached, ["case", "entity"], "left_anti"), "union")
        if not found.limit(1).count():
            break
        reached = reached.unionByName(found)
    return reached.filter("case <> entity")


def pooled(scores: DataFrame, universe: int | None = None, weight=None) -> DataFrame:
    """One row over the cases that have a truth: cases, n, hits, truth, precision, recall, f1 (and lift).

    Lift is the precision over that of naming entities at random out of ``universe`` per case.
    """
    w = F.lit(1) if weight is None else weight
    sums = scores.filter("truth > 0").agg(*[F.coalesce(F.sum(x * w), F.lit(0)).alias(a) for a, x in (("cases", F.lit(1)), ("n", F.col("n")), ("hits", F.col("hits")), ("truth", F.col("truth")))])
    out = sums.withColumns({"precision": _ratio(F.col("hits"), F.col("n")), "recall": _ratio(F.col("hits"), F.col("truth")), "f1": _ratio(2 * F.col("hits"), F.col("n") + F.col("truth"))})
    return out if universe is None else out.withColumn("lift", _ratio(F.col("precision") * F.col("cases") * universe, F.col("truth")))


def bootstrap(scores: DataFrame, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """(statistic, low, high, defined): 95 % percentile intervals of pooled precision, recall and f1.

    A resample gives every case a Poisson(1) weight drawn from a hash of (seed, case, resample), which
    approaches drawing cases with replacement and needs neither a count nor an order of the cases: reruns
    agree, and rows are combined per resample before they are shuffled.
    """
    each = scores.filter("truth > 0").withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = (F.xxhash64(F.lit(seed), "case", "resample").bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    steps, p, total = [], 2.718281828459045**-1, 0.0
    for k in range(1, 16):
        total += p
        steps.append(F.when(F.col("_u") >= total, 1).otherwise(0))
        p /= k
    drawn = each.withColumn("_u", u).withColumn("_w", sum(steps[1:], steps[0]))
    sums = drawn.groupBy("resample").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in ("n", "hits", "truth")])
    stats = {"precision": _ratio(F.col("hits"), F.col("n")), "recall": _ratio(F.col("hits"), F.col("truth")), "f1": _ratio(2 * F.col("hits"), F.col("n") + F.col("truth"))}
    long = sums.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in stats]), F.array(*stats.values()))).alias("statistic", "value"))
    order = F.sort_array(F.collect_list("value"))  # one number a resample
    m = F.size("_all")
    got = long.groupBy("statistic").agg(order.alias("_all"))
    return got.select("statistic", F.get("_all", F.floor(m / 40).cast("int")).alias("low"), F.get("_all", F.ceil(39 * m / 40).cast("int") - 1).alias("high"), m.alias("defined"))
