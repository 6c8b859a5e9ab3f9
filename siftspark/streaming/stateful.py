"""Streams whose state ends: admission by an exact log, wake-ups, versioned reviews with conflicts apart, barriers closed inside the stream, ingestion into buckets.

All are stateful processors: list and value state with event-time timers in the RocksDB store, so
all keys' state may outgrow memory, and a key's goes when its time is over. Keys with little state (reviews, wake-ups) share the state
of a bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from siftspark.sources.shared import shared_folder

from .state import BUCKETS, _parts, bucketed, judged, let_through, packed, unpacked

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000


def run_stateful(stream: DataFrame, outputs: dict[str, Callable[[DataFrame], DataFrame]] | None = None, progress: list | None = None) -> dict[str, DataFrame]:
    """Runs a stream of stateful processors to its end: each trigger writes every output (all rows, if none is named) to a table of its own in the shared folder.

    A trigger that is repeated after a failure writes the same files again, so each row is in its
    output once. progress gets what Spark reports of each trigger.
    """
    spark = stream.sparkSession
    outputs = outputs or {"all": lambda x: x}
    root = f"{shared_folder(spark)}/stateful-{uuid.uuid4().hex}"
    schemas: dict[str, StructType] = {name: f(spark.createDataFrame([], stream.schema)).schema for name, f in outputs.items()}
    wrote: set[int] = set()

    def write(batch: DataFrame, k: int) -> None:
        batch.persist()  # one run of the processors feeds every output
        for name, f in outputs.items():
            f(batch).write.mode("overwrite").parquet(f"{root}/{name}/batch={k}")
        batch.unpersist()
        wrote.add(k)

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}-checkpoint").foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    if progress is not None:
        progress.extend(query.recentProgress)
    return {n: spark.read.schema(s).parquet(*[f"{root}/{n}/batch={k}" for k in sorted(wrote)]) if wrote else spark.createDataFrame([], s) for n, s in schemas.items()}


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")  # what one trigger brings of one key


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Rows as a frame of plain objects: what Spark's state workers can send, strings too."""
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(columns)})


class _Admission(StatefulProcessor):
    """The log of one key's admitted requests of the last minute, and the leases of those that run."""

    def __init__(self, requests: int, tokens: int, running: int, seconds: int, lease: int) -> None:
        self.requests, self.tokens, self.running, self.span, self.lease = requests, tokens, running, seconds * MICROS, lease * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "ts long, tokens long")
        self.active = handle.getListState("active", "id long, until long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        log, active = [tuple(x) for x in self.log.get()], [tuple(x) for x in self.active.get()]
        out = []
        for r in _sorted(rows, ["micros", "id"]).itertuples():
            if r.ends:  # a request that has ended frees its lease
                active = [a for a in active if a[0] != r.id]
                continue
            log = [x for x in log if x[0] > r.micros - self.span]
            active = [a for a in active if a[1] > r.micros]
            reason, wait = None, 0
            if len(active) >= self.running:
                reason, wait = "RUNNING", 2
            elif len(log) >= self.requests or sum(x[1] for x in log) + r.tokens > self.tokens:
                reason = "REQUESTS" if len(log) >= self.requests else "TOKENS"
                first = min((x[0] for x in log), default=None)
                wait = self.span // MICROS if first is None else max(1, ceil((self.span + first - r.micros) / MICROS))
            else:
                log.append((r.micros, r.tokens))
                active.append((r.id, r.micros + self.lease))
            out.append((key[0], r.id, reason is None, reason, wait))
        self._keep(log, active)
        yield _frame(out, ["key", "id", "admitted", "reason", "wait_seconds"])

    def _keep(self, log: list, active: list) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for state, rows in ((self.log, log), (self.active, active)):
            state.put(rows) if rows else state.clear()
        ends = [x[0] + self.span for x in log] + [a[1] for a in active]
        if ends:
            self.handle.registerTimer(max(ends) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.log.clear()  # all that it holds is older than any row that may still come
        self.active.clear()
        yield _frame([], ["key", "id", "admitted", "reason", "wait_seconds"])

    def close(self) -> None:
        pass


def admitted(events: DataFrame, requests: int, tokens: int, running: int, seconds: int = 60, lease: int = 60, late: str = "1 minute") -> DataFrame:
    """Requests (key string, id, ts, tokens, ends) with admitted, reason and wait_seconds: whether a key has room for one more.

    Only admitted requests enter the log. A key has room while fewer than ``running`` of its
    requests run (each for ``lease`` seconds, or until a row with ``ends`` comes for it: wait 2),
    and the last ``seconds`` hold fewer than ``requests`` and, with this one, at most ``tokens``
    tokens; else the wait is until the oldest of them is out, at least 1, and the whole span where
    the log is empty. Rows of one trigger are judged in order of time, then id; those older than
    the watermark are dropped. A key's state is at most its limits' size and goes with the last row
    that counts. A key is one sequence by its nature: each answer hangs on the one before.
    """
    x = events.withWatermark("ts", late).select("key", F.col("id").cast("long"), F.unix_micros("ts").alias("micros"), F.col("tokens").cast("long"), F.coalesce("ends", F.lit(False)).alias("ends"), "ts")
    out = "key string, id long, admitted boolean, reason string, wait_seconds long"
    return x.groupBy("key").transformWithStateInPandas(_Admission(requests, tokens, running, seconds, lease), out, "append", "EventTime")


class _Buckets(StatefulProcessor):
    """Keys of a bucket, each with a number and the time of its last row: one value of state for all, and one timer, at the first time at which one of them is over."""

    def __init__(self, span: int) -> None:
        self.span = span * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.keys = handle, handle.getValueState("keys", "keys binary, numbers binary, last binary")

    def _known(self) -> dict[int, tuple[int, int]]:
        """Key: (number, time of its last row)."""
        if not self.keys.exists():
            return {}
        return {k: (n, t) for k, n, t in zip(*map(unpacked, self.keys.get()), strict=True)}

    def _over(self, last: int) -> int:
        return (last + self.span) // 1000 + 1

    def _keep(self, known: dict[int, tuple[int, int]]) -> None:
        """Stores what is known and moves the timer."""
        due = self._over(min(t for _, t in known.values())) if known else None
        there = list(self.handle.listTimers())
        for t in there:
            if t != due:
                self.handle.deleteTimer(t)
        if not known:
            self.keys.clear()
            return
        numbers, last = zip(*known.values(), strict=True)
        self.keys.update((packed(known), packed(numbers), packed(last)))
        if due not in there:
            self.handle.registerTimer(due)

    def _swept(self, timerValues) -> None:  # noqa: N803
        """Takes away the keys that are over by the watermark, after the trigger's rows."""
        mark = timerValues.getCurrentWatermarkInMs()
        self._keep({k: (n, t) for k, (n, t) in self._known().items() if self._over(t) > mark})

    def close(self) -> None:
        pass


class _Wakeups(_Buckets):
    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        last = {k: t for k, (_, t) in self._known().items()}
        out = let_through(_sorted(rows, ["key", "micros"]), last, self.span, key[0])
        self._keep({k: (0, t) for k, t in last.items()})
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self._swept(timerValues)
        yield _frame([], ["key", "micros"])


def wakeups(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Of each key's events (key, ts) those that come seconds or more after the last one let through. A key is forgotten once the watermark has passed that time; older rows are dropped."""
    x = bucketed(events.withWatermark("ts", late).select("key", F.unix_micros("ts").alias("micros"), "ts"), "key").groupBy("none", "bucket")
    x = x.transformWithStateInPandas(_Wakeups(seconds), "key long, micros long", "append", "EventTime")
    return x.select("key", F.timestamp_micros("micros").alias("ts"))


class _Versions(_Buckets):
    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        rows, known = _sorted(rows, ["pair_id", "seq"]), self._known()
        here = rows.groupby("pair_id")[["stored", "micros"]].max()
        for pair, stored, micros in zip(here.index.tolist(), here["stored"].tolist(), here["micros"].tolist(), strict=True):
            version, last = known.get(pair, (stored, 0))
            known[pair] = (version, max(last, micros))
        versions = {pair: version for pair, (version, _) in known.items()}
        out = judged(rows, versions, key[0])
        self._keep({pair: (versions[pair], last) for pair, (_, last) in known.items()})
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self._swept(timerValues)
        yield _frame([], ["pair_id", "seq", "decision", "accepted", "version"])


def versioned(events: DataFrame, idle: int = 86_400, late: str = "1 hour") -> DataFrame:
    """Reviews (pair_id, seq, ts, expected, decision, stored) with accepted and version: one counts if it expects the version that its pair then has.

    A pair's version is forgotten once the watermark is ``idle`` seconds past its last review; it then
    starts from ``stored``, the version that the table of reviews has (null: 0). Rows older than the
    watermark are dropped. Rows of one trigger are judged in order of seq.
    """
    x = events.withWatermark("ts", late).select("pair_id", "seq", F.unix_micros("ts").alias("micros"), F.col("expected").cast("long"), "decision", F.coalesce(F.col("stored").cast("long"), F.lit(0)).alias("stored"), "ts")
    return bucketed(x, "pair_id").groupBy("none", "bucket").transformWithStateInPandas(_Versions(idle), "pair_id long, seq long, decision string, accepted boolean, version long", "append", "EventTime")


#: Reviews that count, and those that come too late, each in a table of their own.
REVIEW_SINKS = {"accepted": lambda x: x.where("accepted").drop("accepted"), "conflicts": lambda x: x.where("not accepted").drop("accepted")}


class _Complete(StatefulProcessor):
    """Counts what is there against what is expected, and says so once."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "seen long, expected long, said boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        seen, expected, said = self.counts.get() if self.counts.exists() else (0, None, False)
        for p in rows:
            seen += int(p["ready"].sum())
            told = p["expected"].dropna()
            expected = int(told.iloc[0]) if len(told) else expected
        now = not said and expected is not None and seen >= expected
        self.counts.update((seen, expected, said or now))
        yield _frame([key] if now else [], self.keys)

    def close(self) -> None:
        pass


def complete_jobs(ready: DataFrame, expected: DataFrame) -> DataFrame:
    """Jobs, in the trigger that makes them complete: ready (job, pair_id), each pair once, against a second stream (job, bucket, pairs, buckets) of what to expect.

    Two processors in a chain: pairs are counted by job and bucket of their hash, so that a large job
    is many keys, and a job's full buckets (16 at most) by job. expected has a row for each bucket of a
    job that isn't empty: how many pairs it has, and how many such buckets the job has.
    """
    no_count = F.lit(None).cast("long")
    bucket = F.pmod(F.xxhash64("pair_id"), F.lit(BUCKETS))
    pairs = ready.select("job", bucket.alias("bucket"), F.lit(1).alias("ready"), no_count.alias("expected"))
    first = pairs.unionByName(expected.select("job", F.col("bucket").cast("long"), F.lit(0).alias("ready"), F.col("pairs").cast("long").alias("expected")))
    full = first.groupBy("job", "bucket").transformWithStateInPandas(_Complete(["job", "bucket"]), "job string, bucket long", "append", "None")
    jobs = full.select("job", F.lit(1).alias("ready"), no_count.alias("expected")).unionByName(expected.select("job", F.lit(0).alias("ready"), F.col("buckets").cast("long").alias("expected")))
    return jobs.groupBy("job").transformWithStateInPandas(_Complete(["job"]), "job string", "append", "None")


def ingest_buckets(documents: DataFrame, target: str | None = None, digits: int = 3, progress: list | None = None) -> tuple[DataFrame, str]:
    """Appends documents (doc_id, text) whose content is new to the table at target, the first by doc_id of each trigger: the table, and where it is.

    The table lies in 16**digits folders by the first digits of the content's hash. A trigger reads
    the hashes of its own rows' folders only, so what it reads follows the batch, not the table. Each
    trigger writes files of its own, so that one that is repeated writes the same ones again.
    """
    spark: SparkSession = documents.sparkSession
    target = target or f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    x = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    x = x.withColumn("bucket", F.left("hash", F.lit(digits)))
    schema = "hash string, doc_id long, bucket string, part long"

    def known(before: int) -> DataFrame:
        if not _parts(spark, target):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(target).where(F.col("part") < before)

    def write(batch: DataFrame, k: int) -> None:
        new = batch.groupBy("bucket", "hash").agg(F.min("doc_id").alias("doc_id")).persist()
        here = [r.bucket for r in new.select("bucket").distinct().collect()]  # 16**digits at most
        fresh = new.join(known(k).where(F.col("bucket").isin(here)).select("bucket", "hash"), ["bucket", "hash"], "left_anti")
        fresh.withColumn("part", F.lit(k)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "part").parquet(target)
        new.unpersist()

    query = x.writeStream.option("checkpointLocation", f"{target}-checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    return known(1 << 62).drop("part", "bucket"), target
