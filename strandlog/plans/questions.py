"""The composite questions, each one declarative plan over the log at a knowledge token."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog import schema
from strandlog.functions.identity import fingerprint
from strandlog.functions.text import contains_folded, description_change, payload_name, payload_namespace, printable
from strandlog.functions.text import NAME_KEYS, NAMESPACE_KEYS
from strandlog.operators import fold, log as reads, ranges, spans
from strandlog.schema import type_of

SECOND = 1_000_000_000


def neighbors_at(log: DataFrame, t: int, token: int | None = None, frontier: DataFrame | None = None, direction: str = "forward") -> DataFrame:
    """(entity, peer, relation, quarantined): edges alive at t whose ends are both alive then.

    An edge with a quarantined end is shown uncut.  Without a frontier, of every entity.
    """
    known = reads.visible(log, token)
    near, far = ("source", "target") if direction == "forward" else ("target", "source")
    edges = known.filter("subject_kind = 'edge'")
    if frontier is not None:
        edges = edges.join(frontier.select(F.col("entity").alias(near)).distinct(), near, "left_semi")
    alive = reads.alive_subjects(edges, t).select(F.col(near).alias("entity"), F.col(far).alias("peer"), "relation").distinct()
    ids = reads.alive_subjects(known.filter("subject_kind = 'entity'"), t).select(F.col("source").alias("id")).distinct()
    if "boot" not in log.columns:
        both = alive.join(ids, F.col("entity") == F.col("id"), "left_semi").join(ids, F.col("peer") == F.col("id"), "left_semi")
        return both.withColumn("quarantined", F.lit(False))
    bad = fold.quarantined(known).select(F.col("source").alias("bad"))
    marked = alive.join(bad, F.col("entity") == F.col("bad"), "left").withColumnRenamed("bad", "b1").join(bad, F.col("peer") == F.col("bad"), "left")
    marked = marked.withColumn("quarantined", F.col("b1").isNotNull() | F.col("bad").isNotNull()).drop("b1", "bad")
    clean = marked.filter("not quarantined").join(ids, F.col("entity") == F.col("id"), "left_semi").join(ids, F.col("peer") == F.col("id"), "left_semi")
    return clean.unionByName(marked.filter("quarantined"))


def entity_history(log: DataFrame, entities: DataFrame, from_ns: int, to_ns: int, token: int | None = None) -> DataFrame:
    """(source, start, end, end_source, before, producers) per requested entity; one without pieces has a row of nulls."""
    own = reads.visible(log, token).filter("subject_kind = 'entity'").join(entities.select(F.col("entity").alias("source")).distinct(), "source", "left_semi")
    pieces = ranges.producers_of(ranges.entity_pieces(own, from_ns, to_ns), own.filter(F.col("event_time_ns") < to_ns))
    return entities.select(F.col("entity").alias("source")).distinct().join(pieces.select("source", "start", "end", "end_source", "before", "producers"), "source", "left")


def history_records(log: DataFrame, entities: DataFrame, from_ns: int, to_ns: int, token: int | None = None) -> DataFrame:
    """(source, seq, event_time_ns, producer, kind): the raw existence records of the entities in the window, overwritten ones too."""
    own = reads.visible(log, token).join(entities.select(F.col("entity").alias("source")).distinct(), "source", "left_semi")
    return reads.window(own, from_ns, to_ns, "entity").select("source", "seq", "event_time_ns", "producer", "kind")


def existence_of(log: DataFrame, entities: DataFrame, t: int) -> DataFrame:
    """(entity, existence): alive, not_alive or quarantined at t."""
    ids = entities.select("entity").distinct()
    alive = reads.alive_subjects(log.filter("subject_kind = 'entity'"), t).select(F.col("source").alias("entity"), F.lit(True).alias("alive")).distinct()
    out = ids.join(alive, "entity", "left")
    if "boot" in log.columns:
        out = out.join(fold.quarantined(log).select(F.col("source").alias("entity"), F.lit(True).alias("bad")), "entity", "left")
    else:
        out = out.withColumn("bad", F.lit(False))
    return out.select("entity", F.when(F.col("bad"), "quarantined").when(F.col("alive"), "alive").otherwise("not_alive").alias("existence"))


def names(log: DataFrame, t: int, entities: DataFrame | None = None) -> DataFrame:
    """(entity, name, namespace) of the entities of a named type as described at t; what may not be printed is null."""
    known = log.filter("subject_kind = 'entity'")
    if entities is not None:
        known = known.join(entities.select(F.col("entity").alias("source")).distinct(), "source", "left_semi")
    described = fold.describe_at(known, t)
    out = None
    for kind in NAME_KEYS:
        own = described.filter(type_of(F.col("subject")) == kind)
        shown = [F.when(printable(c), c).alias(n) for c, n in ((payload_name(F.col("payload"), kind), "name"), (payload_namespace(F.col("payload"), kind), "namespace"))]
        rows = own.select(F.col("subject").alias("entity"), *shown)
        out = rows if out is None else out.unionByName(rows)
    return out


class Retained(ValueError):
    """A description was asserted before the horizon, and its payload is no longer kept."""


def descriptions(log: DataFrame, from_ns: int, to_ns: int, ranks: DataFrame | None = None, horizons: dict[str, int] | None = None) -> DataFrame:
    """(subject, from_producer, from_payload, last_producer, last_payload): descriptions at from and just before to.

    Where a layer has a horizon, a winner asserted before it raises ``Retained``: what is not known is not guessed.
    """
    a, b = fold.describe_at(log, from_ns, ranks), fold.describe_at(log, to_ns - 1, ranks)
    for found in (a, b) if horizons else ():
        gone = retained(found, horizons).filter("retained").limit(1).collect()
        if gone:
            raise Retained(f"{gone[0]['subject']}: {gone[0]['producer']} asserted it at {gone[0]['event_time_ns']}, before what is kept")
    a = a.select("subject", F.col("producer").alias("from_producer"), F.col("payload").alias("from_payload"))
    return a.join(b.select("subject", F.col("producer").alias("last_producer"), F.col("payload").alias("last_payload")), "subject", "full")


def retained(described: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """Descriptions with ``retained``: whether the winner was asserted before its layer's horizon."""
    before = F.coalesce(*[F.when(F.col("layer") == k, F.col("event_time_ns") < h) for k, h in horizons.items()], F.lit(False))
    return described.withColumn("retained", before)


def find_entities(log: DataFrame, entity_type: str, from_ns: int, to_ns: int, name: str | None = None, namespace: str | None = None, after: str = "", page: int = 256, token: int | None = None) -> DataFrame:
    """A page of entities of a type and their fate: (entity, fate, name, namespace, class, n_pieces, duration_ns).

    fate: quarantined; absent (no piece in the window); undescribed (a filter is given and there is no description);
    not_printed (a filter is given and the name or namespace may not be shown); not_matched; or match: the name contains
    ``name`` (case folded) and the namespace is ``namespace``.  A name that may not be shown is null.
    """
    if entity_type in ("host", "topo.endpoint"):
        raise ValueError(f"{entity_type} cannot be searched")
    known = reads.visible(log, token)
    ids = reads.list_entities(known, entity_type, after, page).select(F.col("entity").alias("source"))
    own = known.filter("subject_kind = 'entity'").join(F.broadcast(ids), "source", "left_semi")  # at most one page
    classes = ranges.classify(ranges.entity_pieces(own, from_ns, to_ns), from_ns, to_ns)
    d = descriptions(own, from_ns, to_ns)
    x = ids.withColumnRenamed("source", "subject").join(classes, "subject", "left").join(d, "subject", "left")
    payload = F.coalesce("last_payload", "from_payload")
    x = x.withColumns({"_name": payload_name(payload, entity_type), "_space": payload_namespace(payload, entity_type)})
    if "boot" in known.columns:
        x = x.join(fold.quarantined(known).select(F.col("source").alias("subject"), F.lit(True).alias("_bad")), "subject", "left")
    else:
        x = x.withColumn("_bad", F.lit(None).cast("boolean"))
    filtered = F.lit(name is not None or namespace is not None)
    shown = lambda c: F.when(printable(F.col(c)), F.col(c))
    hidden = (F.lit(name is not None) & F.col("_name").isNotNull() & shown("_name").isNull()) | (F.lit(namespace is not None) & F.col("_space").isNotNull() & shown("_space").isNull())
    matches = F.lit(True)
    if name is not None:
        matches = matches & F.coalesce(contains_folded(shown("_name"), name), F.lit(False))
    if namespace is not None:
        matches = matches & F.coalesce(shown("_space") == namespace, F.lit(False))
    described = F.col("last_producer").isNotNull() | F.col("from_producer").isNotNull()
    fate = F.when(F.col("_bad"), "quarantined").when(F.col("n_pieces").isNull(), "absent").when(filtered & ~described, "undescribed").when(hidden, "not_printed").when(~matches, "not_matched").otherwise("match")
    return x.select(F.col("subject").alias("entity"), fate.alias("fate"), shown("_name").alias("name"), shown("_space").alias("namespace"), "class", "n_pieces", "duration_ns")


def resolve_entity(spark: SparkSession, log: DataFrame, entity_type: str, attributes: dict[str, str], t: int, namespace: str) -> DataFrame:
    """(entity, existence): the fingerprint of exact attributes, and alive, not_alive or quarantined at t."""
    row = spark.range(1).select(fingerprint(entity_type, {k: F.lit(v) for k, v in attributes.items()}, namespace).alias("entity"))
    return existence_of(log, row, t)


# The words of the answers, and what they mean here.
VOCABULARY = [
    ("basis", "fact", "a stored record, as stored"), ("basis", "derived", "computed from records at a token under the rules' versions"),
    ("subject", "asserted", "an entity or relation that a producer asserted"), ("subject", "derived", "what no producer asserted: a reach, a co-resident, a pair"),
    ("rule", "existence", "existence folded from records"), ("rule", "recency", "how long a dependency was not seen for certain"), ("rule", "blast_radius.reach", "reached from a failing seed over edges that all exist at once"),
    ("rule", "co_residency.shared_node", "two pods on one node at once"), ("rule", "co_residency.shared_host", "two pods on two nodes of one host at once"),
    ("rule", "pair.shared_pod", "two services in one pod"), ("rule", "pair.shared_node", "two services with pods on one node at once"), ("rule", "pair.shared_host", "two services with pods on one host at once"),
    ("end_reason", "producer", "deleted by its producer"), ("end_reason", "liveness_expiry", "not seen for longer than its TTL"), ("end_reason", "cascade", "an end of it ended"), ("end_reason", "retention", "before what is kept"),
    ("end_reason", "operator", "taken out by an operator"), ("end_reason", "unattributed", "not known"), ("end_reason", "reach_ended", "a derived span ended where one of its legs did"), ("end_reason", "null", "reaches the end of the window"),
    ("class", "stable", "one span, the whole window"), ("class", "appeared", "one span, from inside to the end"), ("class", "disappeared", "one span, from the start to inside"), ("class", "transient", "one span, inside"), ("class", "flapping", "two spans or more"),
]


def describe_schema(spark: SparkSession) -> DataFrame:
    """(what, name, layer, detail): entity types with their keys, relations with their ends, names' keys, and the vocabulary."""
    e = schema.entity_types(spark).select(F.lit("entity").alias("what"), F.col("type").alias("name"), "layer", F.col("identifying_keys").alias("detail"))
    r = schema.relations(spark).select(F.lit("relation").alias("what"), F.col("relation").alias("name"), "layer", F.concat_ws(" ", "from_type", "to_type", "propagation").alias("detail"))
    keys = [("name key", t, None, " ".join(k)) for t, k in NAME_KEYS.items()] + [("namespace key", t, None, " ".join(k)) for t, k in NAMESPACE_KEYS.items()]
    words = [(kind, term, None, meaning) for kind, term, meaning in VOCABULARY]
    return e.unionByName(r).unionByName(spark.createDataFrame(keys + words, "what string, name string, layer string, detail string"))


def graph_diff(log: DataFrame, t1: int, t2: int, token: int | None = None, scope: DataFrame | None = None, horizons: dict[str, int] | None = None) -> DataFrame:
    """(subject, subject_kind, bucket, transient, start, end, end_source, change, state_keys, attribute_keys) of what differs between two instants.

    bucket: created, deleted, changed (entities whose description differs), quarantined, or null; transient marks
    what came and went inside, whatever its bucket.  With ``scope`` (entity) only its entities and the edges at them, each once.
    """
    known, to = reads.visible(log, token), t2 + 1
    entities, edges = ranges.entity_pieces(known, t1, to), ranges.edge_pieces(known, t1, to)
    described = known.filter("subject_kind = 'entity'").drop("boot")
    if scope is not None:
        ids = scope.select(F.col("entity").alias("_id")).distinct()
        entities = entities.join(ids, F.col("source") == F.col("_id"), "left_semi")
        described = described.join(ids, F.col("source") == F.col("_id"), "left_semi")
        near = edges.join(ids, F.col("source") == F.col("_id"), "left_semi")
        edges = near.unionByName(edges.join(ids, F.col("target") == F.col("_id"), "left_semi").join(ids, F.col("source") == F.col("_id"), "left_anti"))
    marked = edges.filter("uncascaded").select("subject", "subject_kind").distinct()
    pieces = entities.unionByName(edges.filter("not uncascaded").drop("uncascaded"))
    classes = ranges.classify(pieces, t1, to)
    ends = pieces.groupBy("subject").agg(F.first("subject_kind").alias("subject_kind"), F.min("start").alias("start"), F.max(F.struct("end", "end_source")).alias("e"))
    d = descriptions(described, t1, to, horizons=horizons)
    both = d.filter("from_producer is not null and last_producer is not null and (from_producer <> last_producer or not from_payload <=> last_payload)")
    parsed = both.withColumn("change", description_change(F.col("from_payload"), F.col("last_payload")))
    same = F.col("from_producer") == F.col("last_producer")
    keys = lambda c: F.when(same, F.col(f"change.{c}")).otherwise("").alias(c)
    changed = parsed.select("subject", F.when(~same, "source_changed").otherwise(F.col("change.kind")).alias("change"), keys("state_keys"), keys("attribute_keys"))
    x = ends.join(classes.select("subject", "class"), "subject").join(changed.filter("change is not null"), "subject", "left")
    at1, at2 = F.col("start") == t1, F.col("e.end") == to
    bucket = F.when(~at1 & at2, "created").when(at1 & ~at2, "deleted").when(at1 & at2 & (F.col("subject_kind") == "entity") & F.col("change").isNotNull(), "changed")
    told = lambda c: F.when(bucket == "changed", F.col(c)).alias(c)
    out = x.select("subject", "subject_kind", bucket.alias("bucket"), F.col("class").isin("transient", "flapping").alias("transient"), "start", F.col("e.end").alias("end"), F.col("e.end_source").alias("end_source"), told("change"), told("state_keys"), told("attribute_keys"))
    if "boot" in known.columns:
        bad = fold.quarantined(known).select(F.col("source").alias("subject"), F.lit("entity").alias("subject_kind"))
        bad = bad.join(scope.select(F.col("entity").alias("subject")).distinct(), "subject", "left_semi") if scope is not None else bad
        none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "long"), ("end", "long"), ("end_source", "string"), ("change", "string"), ("state_keys", "string"), ("attribute_keys", "string"))]
        shown = bad.unionByName(marked).select("subject", "subject_kind", F.lit("quarantined").alias("bucket"), F.lit(False).alias("transient"), *none)
        out = out.unionByName(shown)
    return out.filter("bucket is not null or transient")


def diff_counts(diff: DataFrame) -> DataFrame:
    """Exact counts per bucket and kind, taken before any cap on a list."""
    named = diff.select("subject_kind", F.explode(F.filter(F.array("bucket", F.when(F.col("transient"), "transient")), lambda b: b.isNotNull())).alias("bucket"))
    return named.groupBy("bucket").agg(F.sum((F.col("subject_kind") == "entity").cast("long")).alias("entities"), F.sum((F.col("subject_kind") == "edge").cast("long")).alias("edges"))


def change_events(log: DataFrame, from_ns: int, to_ns: int, token: int | None = None) -> DataFrame:
    """(at, subject, appear, end_source): every piece boundary strictly inside the window."""
    known = reads.visible(log, token)
    pieces = ranges.entity_pieces(known, from_ns, to_ns).unionByName(ranges.edge_pieces(known, from_ns, to_ns).drop("uncascaded"))
    up = pieces.filter(F.col("start") > from_ns).select(F.col("start").alias("at"), "subject", F.lit(True).alias("appear"), F.lit(None).cast("string").alias("end_source"))
    down = pieces.filter(F.col("end") < to_ns).select(F.col("end").alias("at"), "subject", F.lit(False).alias("appear"), "end_source")
    return up.unionByName(down)


def recency(log: DataFrame, at: int, extend_fraction: float = 0.5, half_life_of_x: float = 0.25) -> DataFrame:
    """(subject, producer, last_seen, silent_ns, confidence) of elements all of whose live producers have a TTL.

    silent is the silence that is certain: what passed since the last sighting less the extension
    interval X = fraction * TTL; confidence is 2 ** (-silent / h) with h = half_life_of_x * X.
    """
    from pyspark.sql import Window

    e = fold.evidence(log, at)
    seen = F.least(F.lit(at), F.greatest("event_time_ns", F.coalesce("through_ns", "event_time_ns"), F.coalesce("latest", "event_time_ns")))
    x = F.floor(F.col("ttl_ns") * extend_fraction)
    e = e.withColumn("last_seen", seen).withColumn("silent_ns", F.greatest(F.lit(0), F.lit(at) - seen - x).cast("long"))
    h = F.floor(x * half_life_of_x)
    e = e.withColumn("confidence", F.when(F.col("silent_ns") <= 0, 1.0).when(h <= 0, 0.0).otherwise(F.pow(F.lit(2.0), -F.col("silent_ns") / h)))
    e = e.withColumn("_watch", F.min("ttl_ns").over(Window.partitionBy("subject")))
    best = Window.partitionBy("subject").orderBy("silent_ns", F.desc("last_seen"), "producer")
    return e.filter("_watch > 0").withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("subject", "producer", "last_seen", "silent_ns", "confidence")
