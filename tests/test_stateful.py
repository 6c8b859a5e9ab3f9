"""Streams whose state ends: over several triggers, with the state that Spark reports after each."""

import datetime as dt
import os

from pyspark.sql import functions as F

from siftspark.streaming import state, stateful

T0 = dt.datetime(2024, 1, 1, 0, 0)
at = lambda s: T0 + dt.timedelta(seconds=s)


def stream(spark, tmp_path, schema, *files):
    """A file for each trigger, in order."""
    folder = tmp_path / "in"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for p in folder.glob("*.parquet"):
            if p.stat().st_mtime > 1_700_001_000:
                os.utime(p, (1_700_000_000 + k * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_only_admitted_requests_count(spark, tmp_path):
    schema = "key string, id long, ts timestamp, tokens long, ends boolean"
    s = stream(
        spark, tmp_path, schema,
        [("a", 1, at(0), 50, None), ("a", 2, at(1), 60, None), ("a", 3, at(2), 10, None), ("b", 4, at(2), 500, None)],
        [("a", 5, at(30), 10, False), ("a", 3, at(31), None, True), ("a", 6, at(32), 10, False), ("a", 7, at(61), 90, False)],
        [("a", 8, at(10_000), 1, False)], [("b", 9, at(20_000), 1, False)],
    )
    seen = []
    got = {r.id: (r.admitted, r.reason, r.wait_seconds) for r in stateful.run_stateful(stateful.admitted(s, 3, 100, 2, 60, 60, "5 seconds"), progress=seen)["all"].collect()}
    assert got == {
        1: (True, None, 0), 2: (False, "TOKENS", 59), 3: (True, None, 0), 4: (False, "TOKENS", 60), 5: (False, "RUNNING", 2), 6: (True, None, 0), 7: (False, "TOKENS", 1),
        8: (True, None, 0), 9: (True, None, 0),
    }
    rows = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in seen]
    assert rows[-1] <= rows[1]  # what no longer counts is gone


def test_wakeups_forget_keys(spark, tmp_path):
    s = stream(spark, tmp_path, "key long, ts timestamp", [(k, at(k)) for k in range(50)], [(k, at(3000 + k)) for k in range(50)], [(99, at(20_000))], [(99, at(40_000))])
    seen = []
    out = stateful.run_stateful(stateful.wakeups(s, 3600, "10 seconds"), progress=seen)["all"]
    assert out.groupBy("key").count().where("count > 1 and key <> 99").count() == 0 and out.count() == 52
    rows = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in seen]
    assert max(rows) >= 50 and rows[-1] < 10


def test_conflicts_have_a_table_of_their_own(spark, tmp_path):
    schema = "pair_id long, seq long, ts timestamp, expected long, decision string, stored long"
    s = stream(
        spark, tmp_path, schema, [(1, 1, at(1), 0, "A", None), (1, 2, at(2), 0, "B", None), (2, 3, at(3), 4, "C", 4)], [(1, 4, at(4), 1, "D", None), (2, 5, at(4), 4, "E", 4)],
        [(7, 6, at(50_000), 0, "F", None)], [(1, 7, at(50_001), 2, "G", 2), (7, 8, at(50_001), 0, "H", None)],
    )
    out = stateful.run_stateful(stateful.versioned(s, 3600, "10 seconds"), stateful.REVIEW_SINKS)
    assert sorted((r.seq, r.version) for r in out["accepted"].collect()) == [(1, 1), (3, 5), (4, 2), (6, 1), (7, 3)]
    assert sorted((r.seq, r.version) for r in out["conflicts"].collect()) == [(2, 1), (5, 5), (8, 1)]
    assert out["conflicts"].columns == ["pair_id", "seq", "decision", "version"]


def test_jobs_complete_in_their_trigger(spark, tmp_path):
    ready = stream(spark, tmp_path, "job string, pair_id long", [("x", 1), ("x", 2), ("y", 3)], [("x", 4), ("y", 5)], [("x", 6), ("z", 9)])
    pairs = [("x", p) for p in (1, 2, 4, 6)] + [("y", p) for p in (3, 5, 7)] + [("z", 9)]
    b = spark.createDataFrame(pairs, "job string, pair_id long").withColumn("bucket", F.pmod(F.xxhash64("pair_id"), F.lit(stateful.BUCKETS))).groupBy("job", "bucket").agg(F.count("*").alias("pairs"))
    b = b.join(b.groupBy("job").agg(F.count("*").alias("buckets")), "job")
    b.coalesce(1).write.parquet(str(tmp_path / "expected"))
    out = stateful.run_stateful(stateful.complete_jobs(ready, spark.readStream.schema(b.schema).parquet(str(tmp_path / "expected"))))["all"]
    assert {(r.job, r.f.split("batch=")[1].split("/")[0]) for r in out.select("job", F.input_file_name().alias("f")).collect()} == {("x", "2"), ("z", "2")}


def test_ingestion_reads_the_folders_of_its_batch(spark, tmp_path):
    schema = "doc_id long, text string"
    first = [(k, f"text {k}") for k in range(300)] + [(300, None), (301, "")]
    folder, target = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(folder))
    source = lambda: spark.readStream.schema(schema).parquet(str(folder))
    assert stateful.ingest_buckets(source(), target, 2)[0].count() == 301
    spark.createDataFrame([(400, "text 7"), (401, "new"), (399, "new")], schema).coalesce(1).write.mode("append").parquet(str(folder))
    table, _ = stateful.ingest_buckets(source(), target, 2)
    assert table.count() == 302 and table.where("doc_id = 399").count() == 1
    known = spark.read.schema("hash string, doc_id long, bucket string, part long").parquet(target).where(F.col("bucket").isin("7f", "80")).select("hash")
    plan = known._jdf.queryExecution()
    known.collect()
    assert "PartitionFilters: [bucket" in plan.toString() and "ReadSchema: struct<hash:string>" in plan.toString()
    scan = plan.executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() <= 4  # of some 190: the folders asked for, a file for each trigger


def test_keys_of_a_bucket_share_state_and_calls(spark, tmp_path):
    """Python is called, and state kept, by bucket, not by key; keys stay apart, null ones and large ones too, and end at their own times."""
    n, big = 3 * state.KEY_BUCKETS, 2**60 + 1
    schema = "pair_id long, seq long, ts timestamp, expected long, decision string, stored long"
    first = [(k, k, at(k), 0, "A", None) for k in range(n)] + [(big, n, at(0), 0, "B", None), (big + 1, n + 1, at(0), 1, None, 1), (None, n + 2, at(0), 0, "C", None)]
    second = [(0, n + 3, at(n), 0, "D", None), (n - 1, n + 4, at(n), 1, "E", None), (None, n + 5, at(n), 0, "F", None), (big, n + 6, at(n), 1, "G", None)]
    third = [(5, n + 7, at(n + 4000), 0, "H", None), (7, n + 8, at(9000), 1, "I", None)]
    fourth = [(5, n + 9, at(n + 4001), 1, "J", None), (3, n + 10, at(n + 4001), 0, "K", None), (n - 1, n + 11, at(n + 4002), 2, "L", None)]
    seen = []
    out = stateful.run_stateful(stateful.versioned(stream(spark, tmp_path, schema, first, second, third, fourth), 5000, "10 seconds"), stateful.REVIEW_SINKS, seen)
    accepted = {(r.pair_id, r.seq): r.version for r in out["accepted"].collect()}
    assert len(accepted) == n + 8 and out["conflicts"].count() == 4
    assert [accepted[k] for k in ((big, n), (big + 1, n + 1), (None, n + 2), (n - 1, n + 4), (big, n + 6))] == [1, 2, 1, 2, 2]
    assert max(o["numRowsTotal"] for p in seen for o in p["stateOperators"]) <= 3 * (state.KEY_BUCKETS + 1)


def test_reviews_and_wakeups_in_batches_share_buckets(spark, tmp_path):
    n = 2 * state.KEY_BUCKETS
    s = stream(spark, tmp_path, "pair_id long, seq long, expected long, decision string", [(k, k, 0, "A") for k in range(n)] + [(None, n, 0, "B")], [(k, n + 1 + k, 1, "C") for k in range(0, n, 2)] + [(None, 3 * n, 0, "D")])
    query = state.reviewed(s).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda b, k: b.write.parquet(f"{tmp_path}/out/batch={k}"))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= state.KEY_BUCKETS + 1
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.where("accepted").count() == n + 1 + n // 2 and out.where("not accepted and pair_id is null and version = 1").count() == 1
