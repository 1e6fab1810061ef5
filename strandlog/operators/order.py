"""Numbers in a total order, without bringing the rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlog.staging import staged

_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, keys: list, into: str = "seq", after: int = 0) -> DataFrame:
    """Adds dense numbers after ``after`` in the order of the keys; rows with equal keys are interchangeable.

    Rows are dealt by ranges of the keys and written; a place is the rows in the ranges before (one
    number a range, summed in one task) and those before in the own range.
    """
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    spread = staged(spread, "ordered").withColumn("_part", F.shiftright("_at", 33))
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))  # one row a range
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit(_PLACE)) + 1 + after
    return spread.join(offsets, "_part").withColumn(into, number.cast("long")).drop("_at", "_part", "_before")
