"""Checks of supplied assessments against the registry of evidence, and the outcomes that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import tier

#: Form of a citation, order of outcomes, severities that need a review.
CITATION = r"^(?:SKILLS|EXPERIENCE|PROJECTS|EDUCATION):[1-9][0-9]*\z"
ORDER = ("SUCCESS", "REVIEW_REQUIRED", "EVALUATION_FAILED")
SEVERE = ("HIGH", "CRITICAL")


def registry(chunks: DataFrame) -> DataFrame:
    """(pair_id, category, ordinal, text) with citation, CATEGORY:n by place in the category (equal ordinals: by text). Blank texts keep their number and are left out."""
    w = Window.partitionBy("pair_id", "category").orderBy("ordinal", "text")
    x = chunks.withColumn("citation", F.concat("category", F.lit(":"), F.row_number().over(w).cast("string")))
    return x.where(F.trim("text") != "")


def check_citations(cited: DataFrame, known: DataFrame) -> DataFrame:
    """(pair_id, category, citation) with reason: MALFORMED_CITATION, UNKNOWN_CITATION, WRONG_CATEGORY, or null for a good one."""
    k = known.select("pair_id", "citation", F.col("category").alias("of"))
    x = cited.join(k, ["pair_id", "citation"], "left")
    reason = F.when(~F.coalesce(F.col("citation").rlike(CITATION), F.lit(False)), "MALFORMED_CITATION").when(F.col("of").isNull(), "UNKNOWN_CITATION")
    return x.select("pair_id", "category", "citation", reason.when(F.col("of") != F.col("category"), "WRONG_CATEGORY").alias("reason"))


def outcome(score: Column, n_reasons: Column, severity: Column) -> Column:
    """struct<status, tier>: any reason or severe flag asks for a review, which has no tier; no score is a failure."""
    status = F.when(score.isNull(), "EVALUATION_FAILED").when((n_reasons > 0) | F.coalesce(severity.isin(*SEVERE), F.lit(False)), "REVIEW_REQUIRED").otherwise("SUCCESS")
    return F.struct(status.alias("status"), F.when(status == "SUCCESS", tier(score)).alias("tier"))


def result_order() -> list[Column]:
    """Successes first, then reviews, then failures; by score, then id."""
    return [F.array_position(F.array(*map(F.lit, ORDER)), F.col("status")).asc(), F.coalesce("score", F.lit(0.0)).desc(), F.col("pair_id").asc()]


def token_budget(prompt: Column, limit: int, framing: int = 128) -> Column:
    """struct<tokens, fits>: a third of the UTF-8 bytes, rounded up, and the framing."""
    n = F.ceil(F.octet_length(F.coalesce(prompt, F.lit(""))) / 3) + framing
    return F.struct(n.alias("tokens"), (n <= limit).alias("fits"))
