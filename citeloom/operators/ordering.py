"""Global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.session import materialise


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """``df`` with its 0-based position in the total order of the columns ``order`` (which must be unique together).

    Rows are range-partitioned by all columns of the order, so ties in the first don't pile up, into as many buckets as the session has shuffle
    partitions (adaptive execution joins small ones). They are written once with the number of their bucket; positions count inside buckets and
    are shifted by the sizes of the buckets before. Only bucket sizes are gathered in one place.
    """
    rows = materialise(df.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()), "ordered")
    sizes = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__b").orderBy(*order)
    placed = rows.withColumn("__r", F.row_number().over(inside)).join(F.broadcast(shifts), "__b")
    return placed.withColumn(name, F.col("__r") - 1 + F.col("__shift")).drop("__b", "__r", "__shift")
