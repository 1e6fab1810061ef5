"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 8), DataFrame functions only.

Every document draws an exponential key -ln(u) / weight, u from a hash of seed and id, weight from
the document's quality; the documents of a source in the order of their keys are a weighted sample
without replacement.  A source whose target is r times its size gives every document floor(r)
times; for the rest of the target it gives, in the order of the keys, the documents whose middle
lies within the remaining budget (so it misses the target by half a document at most).

The running sum over a source is found in two steps, so no source meets in one task: keys are cut
into ranges, the ranges' sums are summed up per source, and each range adds its own running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import words_of

SHARES = (5, 2, 1)
CAP = 3


def source_targets(sizes: DataFrame, shares: tuple[int, ...] = SHARES, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Weights repeat ``shares`` over the sources by code point, null last.  Sharing the total by
    weight, capping at ``cap`` sizes and resharing the excess until none is above ends at
    min(cap * size, level * weight) for the one level that makes the targets add up: sources are
    taken by cap * size / weight, and those before the level are full.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(shares)
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, shares)), rank + 1).cast("double"))
    full = F.col("source_size").cast("double") * cap
    filling = Window.orderBy(full / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.select(
        "*", F.sum(F.col("source_size").cast("double")).over(everything).alias("total"),
        F.coalesce(F.sum(full).over(before), F.lit(0.0)).alias("filled"), F.sum("w").over(after).alias("open_w"),
    )
    s = s.withColumn("level", (F.col("total") - F.col("filled")) / F.col("open_w"))
    # The first source that its level does not fill sets the level for all from it on.
    s = s.withColumn("place", F.row_number().over(filling))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") < full, F.struct("place", "level"))).over(everything)["level"])
    target = F.least(full, F.coalesce(F.col("level") * F.col("w"), full))
    return s.select("source", "source_size", target.alias("target"))


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.length(text)
    marks = length - F.length(F.translate(text, "#*$%&|<>!", ""))
    # Quality weight: 1 for clean prose, down to 0.1 for text full of marks.
    weight = F.greatest(F.lit(0.1), 1 - 8 * marks / F.greatest(length, F.lit(1)))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("double")
    u = (number + 0.5) / float(1 << 48)
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"),
        F.md5(text).alias("digest"), (-F.log(u) / weight).alias("key"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 8, ranges: int = 1024) -> DataFrame:
    """Per document: id, digest, source, size, source_size, target, taken (words, repeats counted).

    A null text counts as empty (size 0, taken 0); null is a source like any other; ties in the key
    go by id, size and digest, and equal rows are interchangeable; an empty table gives an empty
    table; other columns are ignored.  The result depends on the rows and ``seed`` only.
    """
    rows = keyed(docs, id_col, text_col, source_col, seed)
    # 1 - exp(-key) is monotone in the key and spread over (0, 1).
    rows = rows.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), F.lit(ranges - 1)).cast("int"))
    parts = rows.groupBy("source", "range").agg(F.sum("size").alias("part"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("part").over(up_to), F.lit(0)))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    parts = parts.join(t, parts["source"].eqNullSafe(t["t_source"])).select(F.col("source").alias("p_source"), F.col("range").alias("p_range"), "offset", "source_size", "target")
    own = Window.partitionBy("source", "range").orderBy("key", F.col("id").asc_nulls_last(), "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("size").over(own))
    joined = rows.join(parts, rows["source"].eqNullSafe(parts["p_source"]) & (rows["range"] == parts["p_range"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    middle = F.col("offset") + F.col("sum") - F.col("size") / 2
    joined = joined.withColumn("epochs", epochs).withColumn("copies", F.col("epochs") + F.when((F.col("size") > 0) & (middle <= rest), 1).otherwise(0))
    return joined.select(F.col("id").alias(id_col), "digest", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("int").alias("copies"))
