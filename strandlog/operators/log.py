"""Reads of the log itself: visibility, point reads, windows with seeds, horizons, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.schema import live_at, reject_reason, subject_key


class BeforeHorizon(ValueError):
    """A read reaches back before what retention has kept."""


class AppendRefused(ValueError):
    """A batch is not appended, and nothing of it is."""


def last_seq(log: DataFrame) -> int:
    return log.agg(F.max("seq")).first()[0] or 0


def resolve_token(log: DataFrame, token: int | None = None, strict: bool = False) -> int:
    """The knowledge token to read at: the latest if none or a later one is asked for (strict refuses that)."""
    last = last_seq(log)
    if token is None or (token > last and not strict):
        return last
    if token > last:
        raise ValueError(f"token {token} is after the last record {last}")
    return token


def visible(log: DataFrame, token: int | None) -> DataFrame:
    """Records known at the token; the filter reaches the Parquet scan."""
    return log if token is None else log.filter(F.col("seq") <= token)


def check_horizon(horizons: dict[str, tuple[int, int]], layer: str, from_ns: int, token: int) -> None:
    time, seq = horizons.get(layer, (0, 0))
    if from_ns < time or token < seq:
        raise BeforeHorizon(f"layer {layer} is kept from {time} and seq {seq}")


def check_horizons(log: DataFrame, horizons: dict[str, tuple[int, int]], from_ns: int, token: int | None = None) -> None:
    """Refuses a read of a log that holds records of a layer whose horizon the read passes."""
    for layer, (time, seq) in sorted(horizons.items()):
        if (from_ns < time or (token is not None and token < seq)) and log.filter(F.col("layer") == layer).limit(1).count():
            check_horizon(horizons, layer, from_ns, seq if token is None else token)


def refused(asked: DataFrame, horizons: DataFrame) -> DataFrame:
    """``asked`` (layer, from_ns, token, ...) with ``refused``: whether it reaches before its layer's (layer, time_ns, seq)."""
    h = F.broadcast(horizons.select("layer", "time_ns", "seq"))  # one row a layer
    joined = asked.join(h, "layer", "left")
    return joined.withColumn("refused", F.coalesce((F.col("from_ns") < F.col("time_ns")) | (F.col("token") < F.col("seq")), F.lit(False))).drop("time_ns", "seq")


def advanced(horizons: DataFrame, wanted: DataFrame) -> DataFrame:
    """Horizons (layer, time_ns, seq) moved to those wanted; none moves back, in time or in seq."""
    both = horizons.select("layer", "time_ns", "seq").unionByName(wanted.select("layer", "time_ns", "seq"))
    return both.groupBy("layer").agg(F.max("time_ns").alias("time_ns"), F.max("seq").alias("seq"))


#: How far behind the reference horizon a layer is kept; a layer that is not here is kept whole.
OFFSETS_NS = {"L1": 60 * 86_400_000_000_000, "L2": 0, "L3": 0}


def horizons_at(log: DataFrame, reference_ns: int) -> DataFrame:
    """(layer, time_ns, seq): where the layers' horizons lie for a reference horizon; seq is that of the last record known."""
    rows = [(layer, reference_ns - offset, last_seq(log)) for layer, offset in sorted(OFFSETS_NS.items())]
    return log.sparkSession.createDataFrame(rows, "layer string, time_ns long, seq long")


def append(log: DataFrame, batch: DataFrame, horizons: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The log with a batch, whole or not at all: every record valid, seqs above the log's, none before its layer's horizon."""
    bad = reject_reason(batch).filter("reject_reason is not null").select("seq", "reject_reason").limit(1).collect()
    if bad:
        raise AppendRefused(f"seq {bad[0][0]}: {bad[0][1]}")
    first = batch.agg(F.min("seq")).first()[0]
    if first is not None and first <= last_seq(log):
        raise AppendRefused(f"seq {first} is not after the log's last")
    for layer, (time, _) in (horizons or {}).items():
        if batch.filter((F.col("layer") == layer) & (F.col("event_time_ns") < time)).limit(1).count():
            raise AppendRefused(f"a record of {layer} is before its horizon {time}")
    return log.unionByName(batch, allowMissingColumns=True)


def latest_at(log: DataFrame, t: int) -> DataFrame:
    """The record that decides each (subject, producer) at t: the last by event time, then seq."""
    cols = [c for c in log.columns if c != "subject"]
    at = log.filter(F.col("event_time_ns") <= t).withColumn("subject", subject_key())
    newest = F.max_by(F.struct(*cols), F.struct("event_time_ns", "seq"))
    return at.groupBy("subject", "producer").agg(newest.alias("r")).select("subject", "r.*")


def alive_subjects(log: DataFrame, t: int) -> DataFrame:
    """Subjects that some producer holds alive at t."""
    return latest_at(log.drop("payload"), t).filter(live_at(t)).select("subject", "layer", "subject_kind", "source", "target", "relation").distinct()


class Quarantined(ValueError):
    """A host whose boots collide: two machines under one id, of which nothing is said."""


def alive(log: DataFrame, entities: list[str], t: int) -> DataFrame:
    """(source, alive) of the entities asked for; raises ``Quarantined`` if one of them is a quarantined host."""
    from strandlog.operators import fold

    asked = log.sparkSession.createDataFrame([(e,) for e in entities], "source string")
    if "boot" in log.columns:
        bad = fold.quarantined(log).join(asked, "source", "left_semi").orderBy("source").limit(1).collect()
        if bad:
            raise Quarantined(f"{bad[0]['source']}: boot {bad[0]['boot']} seen at {bad[0]['at']} after a newer one")
    held = alive_subjects(log.filter("subject_kind = 'entity'").join(asked, "source", "left_semi"), t).select("source", F.lit(True).alias("alive")).distinct()
    return asked.join(held, "source", "left").select("source", F.coalesce("alive", F.lit(False)).alias("alive"))


def neighbors(log: DataFrame, frontier: DataFrame, t: int, direction: str = "forward") -> DataFrame:
    """(entity, peer, relation): edges alive at t of every entity of ``frontier`` (column entity); ends are not checked."""
    near, far = ("source", "target") if direction == "forward" else ("target", "source")
    wanted = frontier.select(F.col("entity").alias(near)).distinct()
    edges = log.filter("subject_kind = 'edge'").join(wanted, near, "left_semi")
    return alive_subjects(edges, t).select(F.col(near).alias("entity"), F.col(far).alias("peer"), "relation").distinct()


def window(log: DataFrame, from_ns: int, to_ns: int, subject_kind: str) -> DataFrame:
    """Raw records of a kind in [from, to), overwritten ones included."""
    return log.filter((F.col("subject_kind") == subject_kind) & (F.col("event_time_ns") >= from_ns) & (F.col("event_time_ns") < to_ns))


def window_since(log: DataFrame, from_ns: int, to_ns: int, at_horizon: bool = False, horizons: dict[str, int] | None = None) -> DataFrame:
    """Seeds and window: what is needed to fold [from, to) without older history.

    A seed is the deciding record strictly before ``from`` of a (subject, producer) that is an observe
    live just before it; when ``from`` is the horizon (of all layers, or of the layer in ``horizons``), one live at it.
    """
    before = latest_at(log, from_ns - 1).drop("subject")
    at = [k for k, h in (horizons or {}).items() if h == from_ns]
    just_before = live_at(from_ns if at_horizon else from_ns - 1)
    live = F.when(F.col("layer").isin(at), live_at(from_ns)).otherwise(just_before) if at else just_before
    seeds = before.filter(live).withColumn("part", F.lit("seed"))
    inside = log.filter((F.col("event_time_ns") >= from_ns) & (F.col("event_time_ns") < to_ns)).withColumn("part", F.lit("window"))
    return seeds.unionByName(inside)


def last_assertion(log: DataFrame, references: DataFrame, at_horizon: dict[str, int] | None = None, bound: int | None = None) -> DataFrame:
    """Newest assertion of each (subject, producer) asked for, with outcome found, baseline_only, exhausted or none.

    With ``bound`` the search of a reference looks at no more than that many of the newest records of its
    side (layer and source): one that has not met the reference by then is exhausted, which says nothing.
    """
    keyed = log.withColumn("subject", subject_key())
    facts = ["seq", "event_time_ns", "kind", "layer"]
    if bound is not None:
        side = Window.partitionBy("layer", "source").orderBy(F.desc("event_time_ns"), F.desc("seq"))
        keyed = keyed.withColumn("place", F.row_number().over(side))
        facts.append("place")
    newest = keyed.groupBy("subject", "producer").agg(F.max_by(F.struct(*facts), F.struct("event_time_ns", "seq")).alias("r"))
    out = references.select("subject", "producer").distinct().join(newest, ["subject", "producer"], "left")
    horizon = F.coalesce(*[F.when(F.col("r.layer") == k, F.lit(v)) for k, v in (at_horizon or {}).items()], F.lit(-1)) if at_horizon else F.lit(-1)
    outcome = F.when(F.col("r").isNull(), "none")
    if bound is not None:
        outcome = outcome.when(F.col("r.place") > bound, "exhausted")
    outcome = outcome.when(F.col("r.event_time_ns") < horizon, "baseline_only").otherwise("found")
    told = lambda c: F.when(outcome != "exhausted", F.col(f"r.{c}")).alias(c)
    return out.select("subject", "producer", outcome.alias("outcome"), told("seq"), told("event_time_ns"), told("kind"))


def list_entities(log: DataFrame, entity_type: str, after: str = "", n: int = 256) -> DataFrame:
    """A page of the ids of a type after an id, ascending."""
    ids = log.filter((F.col("subject_kind") == "entity") & F.col("source").startswith(f"{entity_type}:") & (F.col("source") > after)).select(F.col("source").alias("entity")).distinct()
    return ids.orderBy("entity").limit(n)


def retain(log: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """The log kept from a horizon per layer: baselines of what is live there, without payload, and all later records.

    A layer without a horizon is kept whole.
    """
    parts = [log.filter(~F.col("layer").isin(list(horizons)))]
    for layer, h in horizons.items():
        own = log.filter(F.col("layer") == layer)
        parts.append(window_since(own, h, 2**63 - 1, at_horizon=True).withColumn("payload", F.when(F.col("part") == "window", F.col("payload"))).drop("part"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked(df: DataFrame, order: list, by: list[str] = (), into: str = "place") -> DataFrame:
    """Adds the place of each row in a total order, per group."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def capped(df: DataFrame, cap: int, order: list, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` rows of each group by a total order, and (by, listed, dropped) with exact counts.

    Spark keeps ``cap`` rows of a group in every task before they meet, and counts are combined likewise.
    """
    first = ranked(df, order, by).filter(F.col("place") <= cap)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return first, n.select(*by, F.least("_n", F.lit(cap)).alias("listed"), F.greatest(F.col("_n") - cap, F.lit(0)).alias("dropped"))


def gaps(df: DataFrame) -> DataFrame:
    """Places where a chain of seqs is not dense: the gap check of a restore."""
    w = Window.orderBy("seq")
    return df.select("seq").withColumn("before", F.lag("seq").over(w)).filter(F.col("seq") - F.col("before") != 1)
