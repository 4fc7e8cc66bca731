"""Ordinals of a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.session import materialize


def ranks(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ordinals from 0 in a total order.

    The rows are sorted by ranges and written once; ordinals are row numbers within a partition of the sort plus the counts
    of the partitions before it, so no task sees all rows.
    """
    placed = materialize(table.orderBy(*order).withColumn("_p", F.spark_partition_id()), "ordered")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return placed.withColumn("_r", within).join(offsets, "_p").withColumn(name, (F.col("_before") + F.col("_r")).cast("bigint")).drop("_p", "_r", "_before")


def running(table: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before, in a total order; rows that are equal in it may change places.

    As with ``ranks`` no task sees all rows: sums within a partition of the sort, plus those of the partitions before it.
    """
    placed = materialize(table.orderBy(*order).withColumn("_p", F.spark_partition_id()), "ordered")
    sums = placed.groupBy("_p").agg(F.sum(value).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_r", within).join(sums.select("_p", before.alias("_before")), "_p").withColumn(name, (F.col("_before") + F.col("_r")).cast("bigint")).drop("_p", "_r", "_before")
