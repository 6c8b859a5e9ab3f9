"""Evidence coverage of a pair's targets: scores by category, composite, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Retrieval weights of the categories, and kinds of targets that need applied evidence.
WEIGHTS = {"SKILLS": 0.30, "EXPERIENCE": 0.40, "PROJECTS": 0.15, "EDUCATION": 0.15}
APPLIED = ("experience", "responsibility", "project")


def coverage_scores(assessments: DataFrame, minimum: float = 0.0) -> DataFrame:
    """One row for each target of a pair to one row for each pair.

    In: pair_id, category, kind, treatment, importance, coverage, status, accepted_substitute, n_groups (matched). A category's score is the
    mean of its requirements by importance plus a tenth of that of its preferences, at most 1; preferences alone do not make it count.
    The minimum is held against the rounded score, which does not depend on the order of sums.
    Out: composite_score (six places), supported, responsibility_coverage, applied_coverage, eligible, reason.
    """
    pref = F.col("treatment") == "preference"
    kind, cover = F.col("kind"), F.col("coverage")
    mean = lambda on: F.sum(F.when(on, F.col("importance") * cover)) / F.sum(F.when(on, F.col("importance")))
    proof = (F.col("status") == "DIRECT") | F.col("accepted_substitute") | ((cover >= 0.5) & (F.col("n_groups") >= 2))
    applied = kind.isin(*APPLIED) & ~pref
    x = assessments.groupBy("pair_id", "category").agg(
        mean(~pref).alias("main"), mean(pref).alias("extra"), F.count_if(~pref & (cover > 0)).alias("supported"), F.count_if(applied).alias("asked"), F.count_if(applied & proof).alias("proved"),
        F.sum(F.when(kind == "responsibility", cover).otherwise(0.0)).alias("responsibility"), F.sum(F.when(kind.isin("experience", "project"), cover).otherwise(0.0)).alias("applied"),
    )
    score = F.when(F.col("extra").isNotNull(), F.least(F.lit(1.0), F.col("main") + 0.1 * F.col("extra"))).otherwise(F.col("main"))
    weight = F.coalesce(*[F.when(F.col("category") == c, F.lit(w)) for c, w in WEIGHTS.items()], F.lit(0.0))
    x = x.withColumn("score", score).withColumn("weight", F.when(F.col("main").isNotNull(), weight))
    x = x.groupBy("pair_id").agg(
        F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight")), F.lit(0.0)).alias("score"), F.sum("supported").alias("supported"), F.sum("asked").alias("asked"),
        F.sum("proved").alias("proved"), F.sum("responsibility").alias("responsibility_coverage"), F.sum("applied").alias("applied_coverage"),
    )
    score = F.round(F.round("score", 9), 6)  # nine places first: halves do not hang on the order of sums
    ok = (F.col("supported") > 0) & ((F.col("asked") == 0) | (F.col("proved") > 0)) & (score > 0) & (score >= minimum)
    return x.select(
        "pair_id", score.alias("composite_score"), "supported", "responsibility_coverage", "applied_coverage", ok.alias("eligible"),
        F.when(~ok, "INSUFFICIENT_SUPPORTED_RELEVANCE").alias("reason"),
    )
