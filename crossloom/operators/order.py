"""Running totals and row numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossloom.runtime import materialise, partitions


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to its own by ``order`` (a column without ties).

    Rows are range-partitioned by ``order`` and written once with their range's number; sums run within ranges, and ranges' totals
    (one row each) are added up on their own."""
    n = partitions(df.sparkSession)
    dealt = materialise(df.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = totals.withColumn("_before", F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).select("_range", "_before")
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(out, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def row_numbers(df: DataFrame, order: str, out: str) -> DataFrame:
    """``df`` with numbers from 0 by ``order`` (a column without ties)."""
    x = running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out)
    return x.withColumn(out, F.col(out) - 1).drop("_one")
