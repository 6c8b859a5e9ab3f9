"""Places in groups of any size: rows lie in ranges of their order, and prefix sums of the ranges' counts give each its start, so no task holds a whole group."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.sources.shared import shared_folder


def numbered(df: DataFrame, group: str, order: list[Column], place: str = "place", counted: tuple[str, str] | None = None) -> DataFrame:
    """Adds place, from 1 by the order in each group; counted = (flag, name) also adds how many rows up to this one have the flag.

    The order must be total for places to be the same in every run. Rows in their ranges are written
    to the shared folder once, so that ranges and counts belong together after a lost executor too.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    x = df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id())
    x.write.parquet(path)
    x = spark.read.schema(x.schema).parquet(path)
    flag = F.coalesce(F.col(counted[0]).cast("int"), F.lit(0)) if counted else F.lit(0)
    sums = x.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.sum(flag).alias("_f"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), upto("_n").alias("_start"), upto("_f").alias("_flags"))
    inside = Window.partitionBy(group, "_part").orderBy(*order)
    x = x.withColumn("_row", F.row_number().over(inside))
    if counted:
        x = x.withColumn("_seen", F.sum(flag).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn(place, (F.col("_start") + F.col("_row")).cast("long"))
    if counted:
        x = x.withColumn(counted[1], (F.col("_flags") + F.col("_seen")).cast("long"))
    return x.drop("_part", "_g", "_p", "_start", "_flags", "_row", "_seen")
