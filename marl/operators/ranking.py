"""Dense numbering without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marl.sources.shared import cut


def dense_index(df: DataFrame, column: str, name: str = "index") -> DataFrame:
    """(column, name): the distinct non-null values numbered from 0 in ascending order.

    Values are range partitioned; a value's number is its partition's offset plus its place there.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(n, column).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))  # one row a partition
    place = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return spread.join(F.broadcast(offsets), "__part").select(column, (place + F.col("__offset")).cast("long").alias(name))
