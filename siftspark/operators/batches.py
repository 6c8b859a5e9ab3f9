"""Batches of reviews that apply as a whole or not at all, each against the versions that its pairs have when its turn comes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.sources.shared import shared_folder

#: The decision that needs a reason, and the codes of batches that change nothing.
NEEDS_REASON, NO_REASON, CONFLICT = "NOT_PROCEEDING", "REASON_REQUIRED", "VERSION_CONFLICT"


def decided_batches(batches: DataFrame, expected: DataFrame) -> DataFrame:
    """Batches (batch, decision, reason), in order of batch, and what they expect (batch, pair_id, version) to batch, accepted, code.

    A batch is accepted if each of its pairs has the version that it expects, after all batches
    before it; then each of its pairs moves one version on. One that expects a stale version for a
    single pair changes nothing, nor does one without a reason that its decision needs. A batch
    without pairs is accepted. A pair that a batch names twice must be expected alike (rows that differ conflict).

    Rounds, all batches at once: a pair's next batch is the first that expects its present version.
    Those before it can't come true any more, as nothing moves the pair before it does, nor can
    those that expect less. A batch that is next for all of its pairs is accepted. The first batch
    of all that are left is decided in every round, and usually very many are: rounds follow the
    longest chain of accepted batches that overlap, not their number. Each round is written to the
    shared folder. A pair's rows are first brought down to one (partial minima), which is then joined.
    """
    spark = batches.sparkSession
    root = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    bad = (F.col("decision") == NEEDS_REASON) & (F.trim(F.coalesce("reason", F.lit(""))) == "")
    fine = batches.where(~F.coalesce(bad, F.lit(False))).select("batch").distinct()
    left = saved(expected.join(fine, "batch", "left_semi").select("batch", "pair_id", "version").distinct(), "left-0")
    versions = saved(left.select("pair_id", F.lit(0).cast("long").alias("now")).distinct(), "versions-0")
    alone = saved(fine.join(left, "batch", "left_anti").select("batch", F.lit(True).alias("accepted")), "decided/0")
    step = 0
    while not left.isEmpty():
        step += 1
        ready = left.join(versions, "pair_id").where("version = now").groupBy("pair_id").agg(F.min("batch").alias("next"))
        x = left.join(versions, "pair_id").join(ready, "pair_id", "left")
        now = F.col("version") == F.col("now")
        dead = F.col("next").isNull() | (F.col("batch") < F.col("next")) | (F.col("version") < F.col("now")) | ((F.col("batch") == F.col("next")) & ~now)
        of = x.groupBy("batch").agg(F.bool_or(dead).alias("dead"), F.bool_and(F.coalesce((F.col("batch") == F.col("next")) & now, F.lit(False))).alias("ready"))
        done = saved(of.where("dead or ready").select("batch", (~F.col("dead")).alias("accepted")), f"decided/{step}")
        moved = left.join(done.where("accepted"), "batch", "left_semi").groupBy("pair_id").agg(F.lit(1).alias("moved"))
        versions = saved(versions.join(moved, "pair_id", "left").select("pair_id", (F.col("now") + F.coalesce("moved", F.lit(0))).alias("now")), f"versions-{step}")
        left = saved(left.join(done, "batch", "left_anti"), f"left-{step}")
    done = spark.read.schema(alone.schema).parquet(f"{root}/decided/*")
    x = batches.select("batch", bad.alias("bad")).join(done, "batch", "left")
    accepted = F.coalesce("accepted", F.lit(False))
    code = F.when(F.coalesce("bad", F.lit(False)), NO_REASON).when(~accepted, CONFLICT)
    return x.select("batch", accepted.alias("accepted"), code.alias("code"))


def review_state(batches: DataFrame, expected: DataFrame, decided: DataFrame) -> DataFrame:
    """The review of every pair that an accepted batch names: version, batch (the last), decision, reason, and notes, tags and assignee, which a batch without them leaves as they were.

    batches: batch, decision, reason, notes, tags, assignee. An empty assignee takes the old one away.
    """
    x = batches.join(decided.where("accepted").select("batch"), "batch").join(expected.select("batch", "pair_id").distinct(), "batch")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c)
    x = x.groupBy("pair_id").agg(
        F.count("*").alias("version"), F.max("batch").alias("batch"), F.max_by("decision", "batch").alias("decision"), F.max_by(F.trim(F.coalesce("reason", F.lit(""))), F.col("batch")).alias("reason"), last("notes"), last("tags"), last("assignee")
    )
    return x.withColumn("assignee", F.when(F.col("assignee") != "", F.col("assignee")))
