"""Algebra over span tables: rows (key columns, start, end), half-open, in long form.

Overlap joins carry an equality on the key, so Spark hashes or sorts on it and applies the overlap as
a residual condition; no join here is a cross product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators.fold import islands


def union_spans(df: DataFrame, by: list[str]) -> DataFrame:
    return islands(df, by)


def intersect(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a and b with equal ``on`` and overlapping spans; start and end are the overlap's, other columns of both stay."""
    b = b.withColumnRenamed("start", "_bs").withColumnRenamed("end", "_be")
    both = a.join(b, on).filter((F.col("start") < F.col("_be")) & (F.col("_bs") < F.col("end")))
    return both.withColumn("start", F.greatest("start", "_bs")).withColumn("end", F.least("end", "_be")).drop("_bs", "_be")


def along(legs: list[DataFrame], on: list[str]) -> DataFrame:
    return reduce(lambda x, y: intersect(x, y, on), legs)


def sweep(df: DataFrame, by: list[str], weights: dict[str, str]) -> DataFrame:
    """Elementary spans between neighbouring boundaries, with running sums of the weights that hold there."""
    up = df.select(*by, F.col("start").alias("at"), *[F.expr(e).alias(n) for n, e in weights.items()])
    down = df.select(*by, F.col("end").alias("at"), *[(-F.expr(e)).alias(n) for n, e in weights.items()])
    steps = up.unionByName(down).groupBy(*by, "at").agg(*[F.sum(n).alias(n) for n in weights])
    w = Window.partitionBy(*by).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*by, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), *[F.sum(n).over(run).alias(n) for n in weights]).filter("end is not null")


def subtract(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The instants of a that are in no span of b, per key, as maximal spans."""
    both = a.select(*by, "start", "end", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*by, "start", "end", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    left = sweep(both, by, {"na": "_a", "nb": "_b"}).filter("na > 0 and nb = 0")
    return islands(left.select(*by, "start", "end"), by)


def single_claim(claims: DataFrame, by: list[str], target: str) -> DataFrame:
    """(by, target, start, end): instants at which exactly one target is claimed, and which.

    ``claims``: (by, target, start, end).  One sweep counts distinct targets; where there is one, it is
    the claim that covers the stretch.
    """
    own = islands(claims.select(*by, target, "start", "end"), [*by, target])
    alone = sweep(own, by, {"n": "1"}).filter("n = 1").select(*by, "start", "end")
    named = intersect(alone, own, by)
    return islands(named.select(*by, target, "start", "end"), [*by, target])


def ambiguous(claims: DataFrame, by: list[str], target: str) -> DataFrame:
    """(by, start, end): instants at which two targets or more are claimed."""
    own = islands(claims.select(*by, target, "start", "end"), [*by, target])
    return islands(sweep(own, by, {"n": "1"}).filter("n > 1").select(*by, "start", "end"), by)


def containing(points: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``points`` (on, at) with the start and end of each span that holds their instant."""
    return points.join(spans.select(*on, "start", "end"), on).filter((F.col("start") <= F.col("at")) & (F.col("at") < F.col("end")))


def at(df: DataFrame, t: int) -> DataFrame:
    return df.filter((F.col("start") <= t) & (F.col("end") > t))


def duration(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("duration_ns"))
