"""Streams run to their end: results are tables in the shared folder, whole over several batches, not rows in the driver."""

import datetime as dt
import os

from siftspark.streaming import events as streams
from siftspark.streaming import state

T0 = dt.datetime(2024, 1, 1, 0, 0)


def written(spark, folder, rows):
    x = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz")
    x.coalesce(1).write.mode("append").parquet(folder)


def test_streams_are_whole_and_written_by_executors(spark, tmp_path):
    folder = f"{tmp_path}/events"
    for late in (True, False):  # the older events come in a file of their own, after or before the newer ones
        written(spark, folder, [(i, i % 3, "a", 1.0, T0 + dt.timedelta(minutes=20 * i, days=0 if late else 3)) for i in range(30)])
    s = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    s = s.withColumn("ts", s.ts.cast("timestamp"))
    out = streams.run_to_end(streams.sessions(s), "complete")
    assert sum(r.n for r in out.collect()) == 60
    assert out.inputFiles() and all("/stream-" in f for f in out.inputFiles())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("stream_")]
    hours = streams.run_to_end(streams.hourly(s), "complete")
    assert sum(r.n for r in hours.collect()) == 60 and hours.count() == len({(r.hour, r.event_type) for r in hours.collect()})


def test_stream_without_events_is_empty(spark, tmp_path):
    folder = f"{tmp_path}/none"
    written(spark, folder, [])
    s = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    assert streams.run_to_end(streams.sessions(s.withColumn("ts", s.ts.cast("timestamp"))), "complete").count() == 0


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    folder = f"{tmp_path}/late"
    for k, days in enumerate((3, 3, 0, 4)):  # the third file is three days late, by the watermark that the first left
        written(spark, folder, [(100 * k + i, i % 3, "a", 1.0, T0 + dt.timedelta(days=days, minutes=20 * i)) for i in range(30)])
    files = sorted(p for p in (tmp_path / "late").iterdir() if p.suffix == ".parquet")
    for n, p in enumerate(sorted(files, key=lambda p: spark.read.parquet(str(p)).first().event_id)):

        os.utime(p, (1_700_000_000 + n * 60,) * 2)  # the order in which a file stream takes them
    s = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    s = s.withColumn("ts", s.ts.cast("timestamp"))
    hours = streams.run_to_end(streams.hourly(s), "append").collect()
    assert {r.hour.day for r in hours} == {4, 5} and sum(r.n for r in hours if r.hour.day == 4) == 60


def test_state_lives_across_triggers(spark, tmp_path):
    folder = f"{tmp_path}/state"
    for k in range(3):
        written(spark, folder, [(i, i % 2, "a", 1.0, T0 + dt.timedelta(hours=k, minutes=i)) for i in range(10)])
    s = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    s = s.withColumn("ts", s.ts.cast("timestamp"))
    assert streams.run_to_end(state.once(s, "event_id"), "append").count() == 10
    out = streams.run_to_end(state.coalesced(s.select(s.user_id.alias("key"), "ts"), 7200), "append")
    assert sorted((r.key, r.ts.hour) for r in out.collect()) == [(0, 0), (0, 2), (1, 0), (1, 2)]


def test_ingestion_takes_up_where_it_ended(spark, tmp_path):
    folder, target = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "doc_id long, text string"
    for rows in ([(2, "a"), (1, "a"), (3, None)], [(4, "b"), (5, ""), (6, "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        table, _ = state.ingest(spark.readStream.schema(schema).parquet(folder), target)
    assert sorted(r.doc_id for r in table.collect()) == [1, 3, 4]
    assert state.ingest(spark.readStream.schema(schema).parquet(folder), target)[0].count() == 3
