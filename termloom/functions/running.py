"""Running sums over groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, groups: list[str], block: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before each row of its group, in order.

    The order within a group is that of ``block`` first and of ``order`` inside a block. Tasks see
    one block of a group at a time; across blocks only their sums are gathered, so a group's rows
    never meet in one task. ``order`` must be total inside a block for a defined result. Nulls in
    ``value`` count as 0.
    """
    amount = F.coalesce(F.col(value), F.lit(0))
    sums = df.groupBy(*groups, block).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*groups, block, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return within.join(offsets, [*groups, block]).withColumn(out, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset")
