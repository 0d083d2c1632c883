"""Positions of rows within a key, without gathering a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, partitions

#: Up to so many (partition, key) rows are broadcast.
BROADCAST_KEYS = 200_000


def ranked(df: DataFrame, key: str, order: list[str], scratch: Scratch, name: str = "ranked") -> DataFrame:
    """df with ``_rank``, 1 for the first row of its key in this order; null is a key too.

    Rows are range-sorted by key and order, so a large key spans many partitions, and written with their place;
    a row's rank is its place in its partition plus the rows that its key has in earlier partitions. Rows that
    tie in the whole order get ranks in no set order.
    """
    spark = df.sparkSession
    place = df.repartitionByRange(partitions(spark), key, *order).sortWithinPartitions(key, *order)
    place = place.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    place = scratch.save(place, name)
    each = place.groupBy("_part", key).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    each = scratch.save(each.select(F.col("_part").alias("_p"), F.col(key).alias("_k"), "_from", F.coalesce(before, F.lit(0)).alias("_before")), f"{name}-each")
    small = F.broadcast(each) if each.count() <= BROADCAST_KEYS else each
    rows = place.join(small, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    return rows.withColumn("_rank", F.col("_at") - F.col("_from") + F.col("_before") + 1).drop("_part", "_at", "_p", "_k", "_from", "_before")
