"""Consecutive numbers and running sums over a whole table, without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirefold.operators.greedy import cut


def number_rows(df: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """``df`` with ``name`` = 0, 1, 2, ... in a total order.

    Rows are range-partitioned and sorted in place; a row's number is its place in the
    partition plus the size of the partitions before it. The placed rows are written
    once, so both passes see the same partition bounds. Only the partition sizes are
    windowed as a whole: one row per partition.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_part", F.spark_partition_id())
                 .withColumn("_at", F.monotonically_increasing_id()
                             - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)),
                 "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0))
                           .alias("_before"))
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_at"))
            .drop("_part", "_at", "_before"))


def running_sum(df: DataFrame, position: str, amount: Column, name: str,
                block: int = 10_000) -> DataFrame:
    """Running total of ``amount`` by a consecutive ``position``: totals of whole blocks
    first, then inside each block. Amounts are summed as decimals, so the grouping
    does not change the result."""
    exact = amount.cast("decimal(28,12)")
    rows = df.withColumn("_block", F.floor(F.col(position) / block)).withColumn("_amount", exact)
    totals = rows.groupBy("_block").agg(F.sum("_amount").alias("_total"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_block", F.coalesce(
        F.sum("_total").over(before), F.lit(0).cast("decimal(38,12)")).alias("_before"))
    inside = Window.partitionBy("_block").orderBy(position)
    return (rows.join(offsets, "_block")
            .withColumn(name, (F.col("_before") + F.sum("_amount").over(inside)).cast("double"))
            .drop("_block", "_amount", "_before"))
