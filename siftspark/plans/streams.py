"""Streams over the events and orders, run to their end, with what they must leave in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.operators.ranking import TERMINAL
from siftspark.streaming import events as streams
from siftspark.streaming import state

from .catalogue import plan
from .relations import PAIRS, STATES, table


def events(spark, d):
    return streams.event_stream(spark, f"{d}/events.parquet")


@plan("SELECT event_id, user_id FROM events")
def stream_dedup(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ts")
    return streams.run_to_end(state.once(e.union(events(spark, d).where("event_id % 3 = 0").select("event_id", "user_id", "ts")), "event_id").select("event_id", "user_id"), "append")


@plan("""WITH w AS (SELECT event_type AS key, to_timestamp((epoch_us(ts) // 10000000 + 1 + unnest(range(6))) * 10)::TIMESTAMP AS until, user_id AS tokens FROM events)
SELECT key, until, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) > 2 AS over FROM w WHERE until <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE GROUP BY ALL""")
def stream_usage(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("key"), F.col("user_id").alias("tokens"), "ts")
    return streams.run_to_end(state.usage(e, 2), "append").withColumn("until", F.col("until").cast("timestamp_ntz"))


@plan("""WITH s AS (SELECT user_id AS key, ts AS started FROM events WHERE event_type = 'click'), e AS (SELECT user_id AS key, ts AS ended FROM events WHERE event_type = 'purchase'),
 m AS (SELECT least((SELECT max(started) FROM s), (SELECT max(ended) FROM e)) - INTERVAL 10 MINUTE AS mark)
SELECT key, started FROM s WHERE started + INTERVAL 2 HOUR < (SELECT mark FROM m) AND NOT EXISTS (SELECT 1 FROM e WHERE e.key = s.key AND ended >= started AND ended <= started + INTERVAL 2 HOUR)""")
def stream_alarms(spark, d):
    of = lambda kind: events(spark, d).where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), "ts")
    return streams.run_to_end(state.unfinished(of("click"), of("purchase"), "2 hours"), "append").withColumn("started", F.col("started").cast("timestamp_ntz"))


def order_stream(spark, d):
    return spark.readStream.schema(spark.read.parquet(f"{d}/orders.parquet").schema).option("pathGlobFilter", "orders.parquet").parquet(d)


@plan("""WITH RECURSIVE e AS (SELECT o_custkey AS pair_id, o_orderkey AS seq, o_orderstatus AS decision, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, greatest(0, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 3 // 4) AS expected FROM orders),
 f AS (SELECT pair_id, seq, decision, n, expected = 0 AS accepted, (expected = 0)::BIGINT AS version FROM e WHERE n = 1
  UNION ALL SELECT e.pair_id, e.seq, e.decision, e.n, e.expected = f.version, f.version + (e.expected = f.version)::BIGINT FROM f JOIN e ON e.pair_id = f.pair_id AND e.n = f.n + 1)
SELECT pair_id, seq, decision, accepted, version FROM f""")
def stream_reviews(spark, d):
    # what a client believed the version to be when it sent its review: a column of the stream, here made from the table
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    sent = table(spark, d, "orders").select("o_orderkey", F.floor((n - 1) * 3 / 4).alias("expected"))
    e = order_stream(spark, d).join(sent, "o_orderkey").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("seq"), "expected", F.col("o_orderstatus").alias("decision"))
    return streams.run_to_end(state.reviewed(e), "append")


@plan(f"""WITH {PAIRS}, r AS (SELECT o_orderdate::DATE AS job, o_orderkey AS pair_id FROM orders), p AS (SELECT job, count(*) AS expected, count(*) FILTER (status IN ('SHORTLISTED', 'STAGE2_READY', {', '.join(f"'{s}'" for s in TERMINAL)})) AS done FROM r JOIN pairs USING (pair_id) GROUP BY 1) SELECT CAST(p.job AS VARCHAR) AS job FROM p WHERE done = expected""".replace("SELECT job, count(*) AS expected", "SELECT r.job, count(*) AS expected"))
def stream_barrier(spark, d):
    job, bucket = F.col("o_orderdate").cast("date").cast("string"), F.pmod(F.xxhash64("o_orderkey"), F.lit(state.BUCKETS))
    expected = table(spark, d, "orders").groupBy(job.alias("job"), bucket.alias("b")).agg(F.count("*").alias("expected"))
    status = F.element_at(F.array(*map(F.lit, STATES)), (F.col("o_orderkey") % len(STATES) + 1).cast("int"))
    x = order_stream(spark, d).where(status.isin("SHORTLISTED", "STAGE2_READY", *TERMINAL)).select(job.alias("job"), F.col("o_orderkey").alias("pair_id"), bucket.alias("b"))
    done = streams.run_to_end(state.ready_parts(x.join(expected, ["job", "b"])), "append")
    wanted = expected.groupBy("job").agg(F.count("*").alias("buckets"))
    return done.groupBy("job").agg(F.count("*").alias("n")).join(wanted, "job").where("n = buckets").select("job")


@plan("""WITH RECURSIVE r AS (SELECT user_id AS key, min(ts) AS ts FROM events GROUP BY user_id
 UNION ALL SELECT key, n FROM (SELECT r.key, (SELECT min(e.ts) FROM events e WHERE e.user_id = r.key AND e.ts >= r.ts + INTERVAL 6 HOUR) AS n FROM r) WHERE n IS NOT NULL) SELECT key, ts FROM r""")
def stream_coalesced(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("key"), "ts")
    return streams.run_to_end(state.coalesced(e, 6 * 3600), "append").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@plan("SELECT sha256(coalesce(text, '')) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def stream_ingest(spark, d):
    s = spark.readStream.schema(spark.read.parquet(f"{d}/documents.parquet").schema)
    folder, leaf = (f"{d}/documents.parquet", None) if _is_folder(spark, f"{d}/documents.parquet") else (d, "documents.parquet")
    s = s.option("pathGlobFilter", leaf).parquet(folder) if leaf else s.parquet(folder)
    return state.ingest(s.select("doc_id", "text"))[0]


def _is_folder(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
