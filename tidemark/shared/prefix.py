"""Prefix sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def prefix_sums(scratch: Scratch, df: DataFrame, group: list[str], order: list[Column], value: Column, name: str, into: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of each row's group.

    Rows are dealt by ranges of (group, order), so a large group is spread over
    many tasks: each sums its own part, and the sums of the parts before are
    added from a table of one row for each group and part. ``order`` must be
    unique within a group for a reproducible result. Group columns must not be
    null.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn("_value", value).repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    dealt = scratch.keep(dealt, name)
    key = ["_part", *group]
    own = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Without a group there is one row for each part here, and for each part and group else.
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = dealt.groupBy(*key).agg(F.sum("_value").alias("_sum"))
    totals = totals.withColumn("_offset", F.sum("_sum").over(earlier) - F.col("_sum")).drop("_sum")
    inside = dealt.withColumn("_inside", F.sum("_value").over(own) - F.col("_value"))
    return inside.join(totals, key).withColumn(into, F.col("_inside") + F.col("_offset")).drop("_part", "_value", "_inside", "_offset")
