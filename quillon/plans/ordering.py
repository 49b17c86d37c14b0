"""Global row numbers and running sums without a single-partition window.

Rows are sorted by range partitions and materialised with their partition and their place in it;
one row a partition then carries the offsets, which is what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialise

PLACE = (1 << 33) - 1


def ascending(order: list[str | Column]) -> list[Column]:
    """Sort keys, nulls first, as nil sorts before all else."""
    return [F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order]


def number_rows(df: DataFrame, order: list[str | Column], name: str = "rn") -> DataFrame:
    """df with `name`: 1, 2, 3 ... in the given order (ties: in no stated order, so give a
    tie-breaker), and __part, the range partition the row is in."""
    keys = ascending(order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    held = materialise(placed, "ordered")
    parts = held.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count("*").alias("n"))
    offsets = parts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    joined = held.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__offset") + F.col("__id").bitwiseAND(F.lit(PLACE)) + 1).drop("__offset", "__id")


def running_sum(numbered: DataFrame, value: Column, name: str, rn: str = "rn") -> DataFrame:
    """The running sum of `value` in the order of number_rows()."""
    local = Window.partitionBy("__part").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    parts = numbered.groupBy("__part").agg(F.sum(value).alias("n"))
    offsets = parts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    return numbered.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + F.sum(value).over(local)).drop("__offset")
