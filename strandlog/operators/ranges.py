"""Existence of entities and edges in a window [from, to): cascade, clipping, producers, classes, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators import fold, log as reads
from strandlog.schema import hash_of, type_of


def cascade(edges: DataFrame, entities: DataFrame, end: str) -> DataFrame:
    """Edge intervals cut to the existence of one end; the edge's own reason wins a tie, else ``cascade``."""
    e = entities.select(F.col("source").alias("_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    both = edges.join(e, (edges[end] == F.col("_id")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")))
    own = F.col("end") <= F.col("_e")
    both = both.withColumn("end_source", F.when(own, F.col("end_source")).otherwise("cascade"))
    return both.withColumn("start", F.greatest("start", "_s")).withColumn("end", F.least("end", "_e")).drop("_id", "_s", "_e")


def clip(intervals: DataFrame, from_ns: int, to_ns: int) -> DataFrame:
    """Pieces in the window; one that reaches ``to`` ends there with no reason."""
    inside = intervals.filter((F.col("start") < to_ns) & (F.col("end") > from_ns))
    return inside.select(
        *[c for c in intervals.columns if c not in ("start", "end", "end_source")],
        F.greatest("start", F.lit(from_ns)).alias("start"), F.least("end", F.lit(to_ns)).alias("end"),
        (F.col("start") < from_ns).alias("before"), F.when(F.col("end") < to_ns, F.col("end_source")).alias("end_source"),
    )


def seeded(log: DataFrame, from_ns: int, to_ns: int, subject_kind: str, horizons: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The records that decide [from, to): one seed per live reference, and the window's own.

    What is folded grows with the window and with the references alive at its start, not with the history.
    A layer whose horizon lies after ``from`` is refused.
    """
    own = log.drop("payload").filter(F.col("subject_kind") == subject_kind)
    reads.check_horizons(own, horizons or {}, from_ns)
    return reads.window_since(own, from_ns, to_ns, horizons={k: h[0] for k, h in (horizons or {}).items()}).drop("part")


def entity_intervals(log: DataFrame, from_ns: int, to_ns: int, horizons=None) -> DataFrame:
    """Existence of entities as far as it reaches into the window; starts before it are not the true ones."""
    return fold.existence(seeded(log, from_ns, to_ns, "entity", horizons))


def entity_pieces(log: DataFrame, from_ns: int, to_ns: int, horizons=None) -> DataFrame:
    """Existence pieces of the entities; quarantined hosts have none (``elements`` shows them)."""
    pieces = clip(entity_intervals(log, from_ns, to_ns, horizons), from_ns, to_ns)
    return pieces.join(fold.quarantined(log).select("source"), "source", "left_anti") if "boot" in log.columns else pieces


def edge_intervals(log: DataFrame, from_ns: int, to_ns: int, raw: bool = False, horizons=None) -> DataFrame:
    """Edge intervals, cut to the existence of both ends unless ``raw``.

    Edges with a quarantined end come back uncut, with ``uncascaded`` true.
    """
    edges = fold.existence(seeded(log, from_ns, to_ns, "edge", horizons))
    if raw:
        return edges.withColumn("uncascaded", F.lit(False))
    entities = entity_intervals(log, from_ns, to_ns, horizons).select("source", "start", "end")
    if "boot" not in log.columns:
        return cascade(cascade(edges, entities, "source"), entities, "target").withColumn("uncascaded", F.lit(False))
    bad = fold.quarantined(log).select(F.col("source").alias("_bad"))
    marked = edges.join(bad, (F.col("_bad") == F.col("source")), "left").withColumnRenamed("_bad", "_q1").join(bad, F.col("_bad") == F.col("target"), "left")
    marked = marked.withColumn("uncascaded", F.col("_q1").isNotNull() | F.col("_bad").isNotNull()).drop("_q1", "_bad")
    cut = cascade(cascade(marked.filter("not uncascaded"), entities, "source"), entities, "target")
    return cut.unionByName(marked.filter("uncascaded").select(*cut.columns))


def edge_pieces(log: DataFrame, from_ns: int, to_ns: int, raw: bool = False, horizons=None) -> DataFrame:
    return clip(edge_intervals(log, from_ns, to_ns, raw, horizons), from_ns, to_ns)


def elements(log: DataFrame, from_ns: int, to_ns: int) -> DataFrame:
    """(subject, subject_kind, source, target, relation, n_pieces, class, transitions, duration_ns, quarantined) of all subjects
    with a piece, and of quarantined hosts: these have no pieces and class none; an edge at one is marked and keeps its own pieces.
    """
    pieces = entity_pieces(log, from_ns, to_ns).withColumn("uncascaded", F.lit(False)).unionByName(edge_pieces(log, from_ns, to_ns))
    names = ["subject_kind", "source", "target", "relation"]
    facts = pieces.groupBy("subject").agg(*[F.first(c).alias(c) for c in names], F.max("uncascaded").alias("quarantined"))
    out = facts.join(classify(pieces, from_ns, to_ns), "subject")
    if "boot" in log.columns:
        bad = fold.quarantined(log).select(F.col("source").alias("subject"), F.lit("entity").alias("subject_kind"), "source")
        none = [F.lit(None).cast("string").alias(c) for c in ("target", "relation")]
        zero = [F.lit(0).cast("long").alias(c) for c in ("n_pieces", "transitions", "duration_ns")]
        out = out.unionByName(bad.select("subject", "subject_kind", "source", *none, *zero, F.lit("none").alias("class"), F.lit(True).alias("quarantined")))
    return out.select("subject", *names, "n_pieces", "class", "transitions", "duration_ns", "quarantined")


def producers_of(pieces: DataFrame, log: DataFrame) -> DataFrame:
    """The pieces with ``producers``: those with an interval of their own that overlaps the piece, joined by commas."""
    own = fold.existence_by_producer(log).select("subject", F.col("producer"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    keys = ["subject", "start", "end"]
    hit = pieces.select(*keys).join(own, "subject").filter((F.col("_s") < F.col("end")) & (F.col("start") < F.col("_e")))
    names = hit.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("producer")), ",").alias("producers"))
    return pieces.join(names, keys, "left")


def classify(pieces: DataFrame, from_ns: int, to_ns: int) -> DataFrame:
    """(subject, n_pieces, class, transitions, duration_ns)."""
    g = pieces.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.min("start").alias("_s"), F.max("end").alias("_e"),
        F.sum((F.col("start") > from_ns).cast("int") + (F.col("end") < to_ns).cast("int")).alias("transitions"),
        F.sum(F.col("end") - F.col("start")).alias("duration_ns"),
    )
    name = F.when(F.col("n_pieces") > 1, "flapping").when((F.col("_s") == from_ns) & (F.col("_e") == to_ns), "stable").when(F.col("_s") == from_ns, "disappeared").when(F.col("_e") == to_ns, "appeared").otherwise("transient")
    return g.select("subject", "n_pieces", name.alias("class"), "transitions", "duration_ns")


def view_union(found: DataFrame) -> DataFrame:
    """Elements that existed at some instant, and quarantined ones."""
    return found.filter("n_pieces > 0 or quarantined")


def view_intersection(found: DataFrame) -> DataFrame:
    """Elements that existed throughout, and quarantined ones."""
    return found.filter("class = 'stable' or quarantined")


def view_at(pieces: DataFrame, t: int, quarantined: DataFrame | None = None) -> DataFrame:
    """Pieces that hold t; with ``quarantined`` (subject) those subjects too, without start and end."""
    held = pieces.filter((F.col("start") <= t) & (F.col("end") > t))
    if quarantined is None:
        return held
    shown = quarantined.select("subject").distinct()
    return held.join(shown, "subject", "left_anti").select("subject", "start", "end").unionByName(shown.select("subject", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")))


def in_order(df: DataFrame, near: str = "entity", peer: str = "peer") -> DataFrame:
    """Adds ``place``: elements of an entity by peer (type, then hash), then relation."""
    w = Window.partitionBy(near).orderBy(type_of(F.col(peer)), hash_of(F.col(peer)), "relation")
    return df.withColumn("place", F.row_number().over(w))
