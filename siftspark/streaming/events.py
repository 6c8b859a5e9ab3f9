"""Structured Streaming jobs over event tables: each reads a folder of files and runs to its end, for tests and backfills."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.sources.shared import shared_folder


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of events; ts as a timestamp in the session's time zone."""
    schema = spark.read.parquet(path).schema
    folder, _, leaf = path.rpartition("/")
    s = spark.readStream.schema(schema).option("pathGlobFilter", leaf).parquet(folder) if leaf else spark.readStream.schema(schema).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's output once all files there are have been read, in complete mode that of its last batch.

    Executors write each batch to a table of its own under the shared checkpoint folder, so no result passes through the driver.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    batches: list[int] = []

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={k}")
        batches.append(k)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}-checkpoint").foreachBatch(write)
    writer.trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    wanted = [max(batches)] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*[f"{root}/batch={k}" for k in wanted])


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Per hour and type: events, total and largest value, once the hour is closed; in append mode events later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    x = w.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    return x.select(F.col("w.start").alias("hour"), "event_type", "n", "total", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed by a gap; in append mode once nothing can be added."""
    x = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return x.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
