"""Streams with state: deduplication, alarms, reviews, barriers, coalescing and ingestion. State is bounded by watermarks, or by the keys there are."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftspark.sources.shared import shared_folder

#: Parts of a job that count on their own, so that a large job is no single task's work.
BUCKETS = 16
#: Buckets of keys that share one state and one call of Python: a call for each of many small keys costs more than its rows.
KEY_BUCKETS = 1024


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key's first event; a repeat is known for as long as it can be within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def usage(events: DataFrame, requests: int, late: str = "1 minute") -> DataFrame:
    """Per key and minute that ends at every tenth second: requests, tokens and whether they are over the limit; windows appear once they are closed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "60 seconds", "10 seconds").alias("w"), "key")
    x = w.agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return x.select("key", F.col("w.end").alias("until"), "requests", "tokens", (F.col("requests") > requests).alias("over"))


def unfinished(starts: DataFrame, ends: DataFrame, within: str, late: str = "10 minutes") -> DataFrame:
    """Starts (key, ts) that no end (key, ts) follows within the time, once none can any more."""
    s = starts.withWatermark("ts", late).select(F.col("key").alias("s_key"), F.col("ts").alias("started"))
    e = ends.withWatermark("ts", late).select(F.col("key").alias("e_key"), F.col("ts").alias("ended"))
    on = (F.col("s_key") == F.col("e_key")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {within}"))
    return s.join(e, on, "left_outer").where("ended is null").select(F.col("s_key").alias("key"), "started")


def _in_order(parts: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(by, kind="stable")  # the rows that one trigger brings of one bucket of keys


def bucketed(x: DataFrame, key: str) -> DataFrame:
    """Rows with their bucket of keys; rows without a key have buckets of their own (none), where the key is 0, so that keys stay whole numbers."""
    bucket: Column = F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS))
    return x.withColumn("none", F.col(key).isNull()).withColumn("bucket", bucket).withColumn(key, F.coalesce(F.col(key).cast("long"), F.lit(0)))


def packed(values) -> bytes:
    """Whole numbers as bytes, as a bucket's state keeps them."""
    return np.array(list(values), "<i8").tobytes()


def unpacked(raw) -> list[int]:
    return np.frombuffer(bytes(raw), "<i8").tolist()


def plain(columns: dict[str, list]) -> pd.DataFrame:
    """Columns of plain objects: what Spark's state workers can send, strings and nulls too."""
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})


def judged(rows: pd.DataFrame, versions: dict[int, int], none: bool) -> pd.DataFrame:
    """Reviews in order of pair and seq, with accepted and version; versions (of all their pairs) are carried on."""
    accepted, version = [], []
    for pair, expected in zip(rows["pair_id"].tolist(), rows["expected"].tolist(), strict=True):
        accepted.append(expected == versions[pair])
        versions[pair] += accepted[-1]
        version.append(versions[pair])
    pairs = [None] * len(rows) if none else rows["pair_id"].tolist()
    return plain({"pair_id": pairs, "seq": rows["seq"].tolist(), "decision": rows["decision"].tolist(), "accepted": accepted, "version": version})


def let_through(rows: pd.DataFrame, last: dict[int, int], span: int, none: bool) -> pd.DataFrame:
    """Of rows in order of key and micros those that come span or more after their key's last one let through, which is carried on."""
    keys, micros = [], []
    for key, at in zip(rows["key"].tolist(), rows["micros"].tolist(), strict=True):
        if key not in last or at >= last[key] + span:
            last[key] = at
            keys.append(None if none else key)
            micros.append(at)
    return plain({"key": keys, "micros": micros})


def reviewed(events: DataFrame) -> DataFrame:
    """Events (pair_id, seq, expected, decision) with accepted and version: one counts if it expects the version that its pair then has.

    Pairs lie in KEY_BUCKETS buckets by hash; a bucket's state has the versions of its pairs.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        versions = dict(zip(*map(unpacked, state.get), strict=True)) if state.exists else {}
        rows = _in_order(parts, ["pair_id", "seq"])
        for pair in rows["pair_id"].unique().tolist():
            versions.setdefault(pair, 0)
        out = judged(rows, versions, key[0])
        state.update((packed(versions), packed(versions.values())))
        yield out

    out = "pair_id long, seq long, decision string, accepted boolean, version long"
    x = bucketed(events, "pair_id").groupBy("none", "bucket")
    return x.applyInPandasWithState(fold, out, "pairs binary, versions binary", "append", GroupStateTimeout.NoTimeout)


def ready_parts(changes: DataFrame) -> DataFrame:
    """Changes (job, pair_id, expected: pairs of the job's bucket) of pairs that are ready, each pair once, to (job, bucket) when all of a bucket are."""

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        was = seen
        for p in parts:
            seen, want = seen + len(p), int(p["expected"].iloc[0])
        state.update((seen,))
        yield pd.DataFrame([key] if was < want <= seen else [], columns=["job", "bucket"])

    x = changes.withColumn("bucket", F.pmod(F.xxhash64("pair_id"), F.lit(BUCKETS)))
    return x.groupBy("job", "bucket").applyInPandasWithState(count, "job string, bucket long", "seen long", "append", GroupStateTimeout.NoTimeout)


def coalesced(events: DataFrame, seconds: int) -> DataFrame:
    """Of each key's events (key, ts) those that come seconds or more after the last one let through. Keys lie in buckets, as those of reviews."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*map(unpacked, state.get), strict=True)) if state.exists else {}
        out = let_through(_in_order(parts, ["key", "micros"]), last, seconds * 1_000_000, key[0])
        state.update((packed(last), packed(last.values())))
        yield out

    x = bucketed(events.select("key", F.unix_micros("ts").alias("micros")), "key").groupBy("none", "bucket")
    x = x.applyInPandasWithState(fold, "key long, micros long", "keys binary, last binary", "append", GroupStateTimeout.NoTimeout)
    return x.select("key", F.timestamp_micros("micros").alias("ts"))


def ingest(documents: DataFrame, target: str | None = None) -> tuple[DataFrame, str]:
    """Appends documents (doc_id, text) whose content is new to the table at target, the first by doc_id of each trigger: the table, and where it is.

    Each trigger writes a part of its own, so that one that is repeated after a failure writes the
    same part again; a restart with the same target takes up where the last run ended.
    """
    spark = documents.sparkSession
    target = target or f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    x = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    schema = "hash string, doc_id long, part long"

    def known(before: int) -> DataFrame:
        parts = _parts(spark, target)
        return spark.read.schema(schema).parquet(target).where(F.col("part") < before) if parts else spark.createDataFrame([], schema)

    def write(batch: DataFrame, k: int) -> None:
        new = batch.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).join(known(k), "hash", "left_anti")
        new.write.mode("overwrite").parquet(f"{target}/part={k}")

    query = x.writeStream.option("checkpointLocation", f"{target}-checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return known(1 << 62).drop("part"), target


def _parts(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
