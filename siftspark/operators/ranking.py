"""Fusion, ranking, cut-offs and completion, per job and per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

#: Pair states from which nothing changes, and retrieval weights.
TERMINAL = ("EXTRACTION_FAILED", "FILTER_REJECTED", "PROCESSING_FAILED", "CUTOFF_EXCLUDED", "SUCCESS", "REVIEW_REQUIRED", "EVALUATION_FAILED")
CAP, RRF_K = 15, 60


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, keys: list[str], item: str, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over both branches; an item of one branch stays. Adds rrf (6 places) and place."""
    on = [*keys, item]
    both = dense.select(*on, "dense_rank").join(sparse.select(*on, "sparse_rank"), on, "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + k), F.lit(0.0))
    both = both.withColumn("rrf", F.round(part("dense_rank") + part("sparse_rank"), 6))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rrf"), item)))


def top_n_per_job(pairs: DataFrame, n: int = CAP) -> DataFrame:
    """Eligible pairs of each job by score, responsibility and applied coverage, then id; NaN scores take no part."""
    w = Window.partitionBy("job").orderBy(F.desc("score"), F.desc("responsibility"), F.desc("applied"), "pair_id")
    return pairs.where(F.col("eligible") & ~F.isnan("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pool_cutoff(pairs: DataFrame, ready: Column, done: Column, cap: int = CAP) -> DataFrame:
    """Jobs of which every pair is ready or done: all ready pairs are ranked, the first cap eligible are shortlisted.

    Ineligible ones go to review, the rest are cut off. Ranks count all ready pairs, the cap only eligible ones.
    """
    p = pairs.withColumn("ready", ready)
    closed = p.groupBy("job").agg(F.bool_and(F.col("ready") | done).alias("closed")).where("closed").select("job")
    p = numbered(p.where("ready").join(closed, "job", "left_semi"), "job", [F.desc("score"), F.col("pair_id")], "rank", ("eligible", "nth"))
    state = F.when(~F.col("eligible"), "REVIEW_REQUIRED").when(F.col("nth") <= cap, "SHORTLISTED").otherwise("CUTOFF_EXCLUDED")
    return p.select("job", "pair_id", "rank", state.alias("outcome"))


def completion(pairs: DataFrame) -> DataFrame:
    """Per campaign: its jobs, how many are complete (all pairs terminal), and whether all are."""
    job = pairs.groupBy("campaign", "job").agg(F.bool_and(F.col("status").isin(*TERMINAL)).alias("complete"))
    return job.groupBy("campaign").agg(F.count("*").alias("jobs"), F.count_if("complete").alias("complete_jobs"), F.bool_and("complete").alias("complete"))


def merged_intervals(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Total length of the union of each key's spans (overlaps once, touching ones merge) and the number of islands."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = spans.withColumn("new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    x = x.withColumn("island", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))  # equal spans are of one island, whichever of them comes first
    x = x.groupBy(key, "island").agg((F.max(end) - F.min(start)).alias("n"))
    return x.groupBy(key).agg(F.sum("n").alias("covered"), F.count("*").alias("islands"))
