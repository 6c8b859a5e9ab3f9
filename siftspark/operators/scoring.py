"""Versioned decimal scores, tiers and outcomes of supplied assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Final category weights and tier thresholds on the rounded score.
FINAL_WEIGHTS = {"SKILLS": "0.40", "EXPERIENCE": "0.30", "PROJECTS": "0.20", "EDUCATION": "0.10"}
TIERS = ((75, "STRONG_MATCH"), (55, "POTENTIAL_MATCH"))
LOWEST_TIER = "LOW_MATCH"


def tier(score: Column) -> Column:
    out = F.lit(LOWEST_TIER)
    for least, name in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def weighted_scores(assessments: DataFrame) -> DataFrame:
    """(pair_id, category, score) to pair_id, score (decimal, half up, 2 places), tier; null unless exactly the four categories are in 0..100."""
    weight = F.coalesce(*[F.when(F.col("category") == c, F.lit(w).cast("decimal(3,2)")) for c, w in FINAL_WEIGHTS.items()])
    s = F.col("score").cast("decimal(20,12)")
    sound = weight.isNotNull() & s.between(0, 100)
    x = assessments.groupBy("pair_id").agg(
        F.sum(s * weight).alias("total"), F.count_distinct(F.when(sound, F.col("category"))).alias("kinds"), F.count("*").alias("n")
    )
    score = F.when((F.col("kinds") == 4) & (F.col("n") == 4), F.round("total", 2).cast("decimal(5,2)"))
    return x.select("pair_id", score.alias("score")).withColumn("tier", tier(F.col("score")))
