"""Streams with state that ends, run to their end, with what they must leave in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.operators.ranking import TERMINAL
from siftspark.streaming import stateful
from siftspark.streaming.state import BUCKETS

from .catalogue import ORACLES, plan
from .relations import STATES, table
from .streams import _is_folder, events, order_stream, stream_barrier, stream_coalesced, stream_ingest, stream_reviews

#: Limits of the query: an hour's requests and tokens of a type of event, and how many may run for 20 minutes.
REQUESTS, TOKENS, RUNNING, SPAN, LEASE = 4, 2_000, 3, 3600, 1200


@plan(f"""WITH RECURSIVE e AS (SELECT event_type AS key, event_id AS id, epoch_us(ts) AS t, user_id AS tokens, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS id, []::STRUCT(t BIGINT, k BIGINT)[] AS log, []::BIGINT[] AS act, NULL::VARCHAR AS reason, 0::BIGINT AS wait FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT key, n, id, CASE WHEN reason IS NULL THEN list_append(l, {{'t': t, 'k': tokens}}) ELSE l END, CASE WHEN reason IS NULL THEN list_append(a, t + {LEASE}000000) ELSE a END, reason,
   CASE WHEN reason = 'RUNNING' THEN 2 WHEN reason IS NULL THEN 0 WHEN len(l) = 0 THEN {SPAN} ELSE greatest(1, CAST(ceil(({SPAN}000000 + list_min([x.t for x in l]) - t) / 1000000) AS BIGINT)) END
   FROM (SELECT *, CASE WHEN len(a) >= {RUNNING} THEN 'RUNNING' WHEN len(l) >= {REQUESTS} THEN 'REQUESTS' WHEN coalesce(list_sum([x.k for x in l]), 0) + tokens > {TOKENS} THEN 'TOKENS' END AS reason
    FROM (SELECT e.*, [x for x in r.log if x.t > e.t - {SPAN}000000] AS l, [x for x in r.act if x > e.t] AS a FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)))
SELECT key, id, reason IS NULL AS admitted, reason, wait AS wait_seconds FROM r WHERE n > 0""")
def stream_admission(spark, d):
    """Requests of each type of event, admitted by the exact log of those admitted before."""
    e = events(spark, d).select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.col("user_id").alias("tokens"), "ts", F.lit(False).alias("ends"))
    return stateful.run_stateful(stateful.admitted(e, REQUESTS, TOKENS, RUNNING, SPAN, LEASE))["all"]


@plan(ORACLES[stream_coalesced.__name__])
def stream_wakeups(spark, d):
    """One wake-up for each user and six hours; users without an event for that long are forgotten."""
    e = events(spark, d).select(F.col("user_id").alias("key"), "ts")
    return stateful.run_stateful(stateful.wakeups(e, 6 * 3600))["all"].withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@plan(f"SELECT pair_id, seq, decision, version, NOT accepted AS conflict FROM ({ORACLES[stream_reviews.__name__]})")
def stream_review_log(spark, d):
    """Reviews by version: those that count in one table, conflicts in another, here one after the other."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    sent = table(spark, d, "orders").select("o_orderkey", F.floor((n - 1) * 3 / 4).alias("expected"))
    e = order_stream(spark, d).join(sent, "o_orderkey").select(F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("seq"), "expected", F.col("o_orderstatus").alias("decision"), F.lit(0).alias("stored"), F.timestamp_seconds(F.col("o_orderkey") + 1_000_000).alias("ts"))
    out = stateful.run_stateful(stateful.versioned(e), stateful.REVIEW_SINKS)
    return out["accepted"].withColumn("conflict", F.lit(False)).union(out["conflicts"].withColumn("conflict", F.lit(True)))


@plan(ORACLES[stream_barrier.__name__])
def stream_complete_jobs(spark, d):
    """Jobs all of whose pairs are ready, told by the stream itself; what to expect is a stream too."""
    job, bucket = F.col("o_orderdate").cast("date").cast("string"), F.pmod(F.xxhash64("o_orderkey"), F.lit(BUCKETS))
    status = F.element_at(F.array(*map(F.lit, STATES)), (F.col("o_orderkey") % len(STATES) + 1).cast("int"))
    ready = order_stream(spark, d).where(status.isin("SHORTLISTED", "STAGE2_READY", *TERMINAL)).select(job.alias("job"), F.col("o_orderkey").alias("pair_id"))
    per = table(spark, d, "orders").groupBy(job.alias("job"), bucket.alias("bucket")).agg(F.count("*").alias("pairs"))
    per = per.withColumn("buckets", F.count("*").over(Window.partitionBy("job")))
    # the first order of a bucket announces what to expect of it
    first = table(spark, d, "orders").groupBy(job.alias("job"), bucket.alias("bucket")).agg(F.min("o_orderkey").alias("o_orderkey")).join(per, ["job", "bucket"])
    expected = order_stream(spark, d).select("o_orderkey").join(first, "o_orderkey").select("job", "bucket", "pairs", "buckets")
    return stateful.run_stateful(stateful.complete_jobs(ready, expected))["all"]


@plan(ORACLES[stream_ingest.__name__])
def stream_bucketed_ingest(spark, d):
    """Documents whose content is new, into folders by hash."""
    s = spark.readStream.schema(spark.read.parquet(f"{d}/documents.parquet").schema)
    folder, leaf = (f"{d}/documents.parquet", None) if _is_folder(spark, f"{d}/documents.parquet") else (d, "documents.parquet")
    s = s.option("pathGlobFilter", leaf).parquet(folder) if leaf else s.parquet(folder)
    return stateful.ingest_buckets(s.select("doc_id", "text"))[0]
