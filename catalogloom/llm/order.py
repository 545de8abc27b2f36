"""The place of every row in an order over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored


def positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``at``: 0 for the first row in ``order``, 1 for the next, over the whole table.

    Rows are dealt into ranges and sorted there; the ranges' sizes, a row per task, give each its start.
    ``order`` should tell all rows apart, so that equal ones do not share a range. No range is held in
    one piece of memory, and a lost task sorts its own range again.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of the number are the range, the lower 33 the row's place in it.
    laid = stored(laid.withColumn("_own", F.monotonically_increasing_id()))
    part = F.shiftright("_own", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.col("_before") + F.col("_own").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.withColumn("_part", part).join(starts, "_part").select(*df.columns, at.alias("at"))
