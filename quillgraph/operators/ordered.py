"""Numbers and running sums over a whole table in an order, without bringing it to one task.

Rows are dealt by ranges of the order, sorted and written once; the ranges' totals, a row each, are
summed up and added to what runs within each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.session import scratch_path


def _dealt(rows: DataFrame, order: list) -> DataFrame:
    at = scratch_path(rows.sparkSession, "ordered")
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")).write.parquet(at)
    return rows.sparkSession.read.parquet(at)


def _before(dealt: DataFrame, total) -> DataFrame:
    """(_part, _before): what the ranges before hold."""
    earlier = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.groupBy("_part").agg(total.alias("n")).select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their number from 1 in the order. order: column names or sort columns."""
    dealt = _dealt(rows, order)
    wide = dealt.join(F.broadcast(_before(dealt, F.count("*"))), "_part")  # a row a task
    return wide.withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def running(rows: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """rows with the sum of value (null: 0) up to and with them in the order."""
    dealt = _dealt(rows, order)
    inner = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    wide = dealt.withColumn("_inner", inner).join(F.broadcast(_before(dealt, F.sum(F.coalesce(value, F.lit(0))))), "_part")
    return wide.withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_place", "_before", "_inner")
