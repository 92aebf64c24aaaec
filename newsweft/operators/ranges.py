"""Running values over one big scope, computed in parallel by ranges of the order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweft.session import durable


def in_ranges(df: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows laid out and stored in ranges of scope and order, the range in ``_range``."""
    return durable(df.repartitionByRange(*scope, *order).withColumn("_range", F.spark_partition_id()))


def running_number(df: DataFrame, scope: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    """Row number per scope from 0.

    Each range counts its own rows and adds the totals of the ranges before; only one total per
    range and scope is gathered.
    """
    scope = list(scope)
    ranges = in_ranges(df, scope, order)
    before = Window.partitionBy(*scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*scope, "_range").agg(F.count("*").alias("_n"))
    offsets = totals.select(*scope, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*scope, "_range").orderBy(*order)) - 1
    return ranges.withColumn("_inside", inside).join(offsets, [*scope, "_range"]).withColumn(
        name, F.col("_before") + F.col("_inside")
    ).drop("_range", "_inside", "_before")
