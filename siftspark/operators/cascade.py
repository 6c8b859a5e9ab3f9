"""The stages of screening as one outcome for each pair, and views of pools of pairs."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(rules: Column, evidence_ok: Column, place: Column, cap: int, needs_review: Column, judged: Column) -> Column:
    """The one state of a pair: rules (PASS, REVIEW, FAIL, null for an error), whether evidence could be read, place among the eligible, and the judged state."""
    return (
        F.when(rules.isNull(), "PROCESSING_FAILED").when(rules == "FAIL", "FILTER_REJECTED").when(~evidence_ok, "EXTRACTION_FAILED")
        .when(F.coalesce(place <= cap, F.lit(False)), F.coalesce(judged, F.lit("EVALUATION_FAILED"))).when(needs_review, "REVIEW_REQUIRED").otherwise("CUTOFF_EXCLUDED")
    )


def counters(pairs: DataFrame, names: dict[str, Column], keys: list[str]) -> DataFrame:
    """Counts of the rows that meet each condition, all in one pass."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in names.items()])


def drafts(df: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Drafts (status, created, payload) as they stand now: past their days they expire and lose the payload unless approved."""
    gone = (F.col("status") != "APPROVED") & (F.date_diff(now, F.col("created")) >= days)
    return df.withColumn("payload", F.when(~gone, F.col("payload"))).withColumn("status", F.when(gone, "EXPIRED").otherwise(F.col("status")))


def effective_checks(checks: Column, verified: Column) -> Column:
    """Checks (array of rule, status) with the status that a verified fact (map of rule to status) sets; what it was stays as original."""
    now = lambda c: F.try_element_at(verified, c["rule"])
    return F.transform(checks, lambda c: F.struct(c["rule"].alias("rule"), F.coalesce(now(c), c["status"]).alias("status"), c["status"].alias("original")))


def pool_filter(spec: dict) -> Column:
    """A condition on pairs from {column: value}: a list means any of them, (low, high) a range, which leaves unknown values out, and text a part of the column, in any case."""

    def one(name: str, value) -> Column:
        c = F.col(name)
        if isinstance(value, tuple):
            low, high = value
            return reduce(and_, [c.isNotNull(), *([c >= low] if low is not None else []), *([c <= high] if high is not None else [])])
        if isinstance(value, list):
            return c.isin(*value)
        return F.contains(F.lower(c), F.lit(value.lower())) if isinstance(value, str) else c == value

    return F.coalesce(reduce(and_, [one(k, v) for k, v in spec.items()], F.lit(True)), F.lit(False))


def visible(campaigns: DataFrame, shared: DataFrame, owner: Column, key: str) -> DataFrame:
    """Campaigns that are the owner's or shared with them (key): each once."""
    s = shared.select(key).distinct().withColumn("_shared", F.lit(True))
    return campaigns.join(s, key, "left").where(or_(owner, F.coalesce("_shared", F.lit(False)))).drop("_shared")
