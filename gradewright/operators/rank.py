"""A global rank without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.scratch import Scratch


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the position of each row, from 1, in the given total order.

    Rows are range-partitioned and numbered within their partition; the partitions' sizes, one number each, give the
    offsets. The order should be total, else ties are numbered arbitrarily. An empty table stays empty.
    """
    scratch = Scratch(df.sparkSession, "rank")
    parts = scratch.write(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_r", own).join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_o") + F.col("_r")).cast("long")).drop("_p", "_o", "_r")
