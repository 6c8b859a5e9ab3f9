"""What becomes of pairs: notes of rules, support of claims in full, confirmed facts, sorted pools, counters and replays under two policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import quoted
from .context import is_excerpt
from .coverage import coverage_scores
from .lifecycle import pool_order
from .support import NUMBER

#: The counters of a run, by the outcome of each stage.
STAGES = {
    "stage0": ("processed", "failed", "review_required"), "stage1": ("passed", "rejected", "review_required", "failed"), "stage2": ("shortlisted", "failed", "review_required", "excluded"),
    "stage3": ("evaluated", "succeeded", "review_required", "failed"),
}


def rule_summary(checks: Column, metrics: Column) -> Column:
    """struct<status, failed, review, metrics> of checks (array of status, message): any failure fails, else any doubt asks for a review."""
    of = lambda s: F.transform(F.filter(checks, lambda c: c["status"] == s), lambda c: c["message"])
    failed, review = of("FAIL"), of("REVIEW")
    status = F.when(F.size(failed) > 0, "FAIL").when(F.size(review) > 0, "REVIEW").otherwise("PASS")
    return F.struct(status.alias("status"), failed.alias("failed"), review.alias("review"), metrics.alias("metrics"))


def support_reason(claim: Column, quote: Column, source: Column, cited: Column, evidence_id: Column, source_id: Column) -> Column:
    """Why a claim has no support, the first rule that it breaks; null where it has. A claim with an evidence id must name its source's and stand in it; only one without may not leave words out."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    named = evidence_id.isNotNull()
    return (
        F.when(~F.coalesce(cited, F.lit(False)), "INVALID_CLAIM_CITATION").when(blank(claim) | blank(quote), "EMPTY_CLAIM_SUPPORT")
        .when(~named & (F.contains(quote, F.lit("...")) | F.contains(quote, F.lit("…"))), "ELLIPSIS_IN_QUOTE").when(~quoted(source, quote), "QUOTE_NOT_IN_SOURCE")
        .when(named & (evidence_id != source_id), "INVALID_EVIDENCE_ID").when(named & ~is_excerpt(claim, source), "CLAIM_NOT_EXPLICIT_IN_SOURCE")
        .when(F.size(F.array_except(numbers(claim), numbers(quote))) > 0, "NUMERIC_CLAIM_NOT_IN_QUOTE")
    )


def confirmed(pairs: DataFrame) -> DataFrame:
    """Pairs (status, reasons: array of rules, verified: map of rule to status) with the open reasons, those cleared by a confirmed PASS, and whether the pair is provisional."""
    clear = lambda r: F.coalesce(F.try_element_at("verified", r) == "PASS", F.lit(False))
    x = pairs.withColumn("cleared", F.filter("reasons", clear)).withColumn("open", F.filter("reasons", lambda r: ~clear(r)))
    return x.withColumn("provisional", (F.col("status") == "SUCCESS") & (F.size("open") > 0))


def sorted_pages(pool: DataFrame, keys: list[str], descending: bool, limit: int) -> DataFrame:
    """The first page of a pool by each of several keys: key, and the rows as they stand on it; unknown values last, then by id, either way."""
    out = None
    for k in keys:
        x = pool.orderBy(*pool_order(k, descending)).limit(limit).select(F.lit(k).alias("key"), "pair_id")
        out = x if out is None else out.union(x)
    return out


def run_counters(outcomes: DataFrame) -> DataFrame:
    """One row of a run's counters from outcomes (stage0, stage1, stage2, stage3: the outcome of each stage that a candidate reached)."""
    names = [F.count_if(F.col(stage) == o).alias(f"{stage}_{o}") for stage, some in STAGES.items() for o in some if (stage, o) != ("stage3", "evaluated")]
    return outcomes.agg(F.count("*").alias("total_input_candidates"), *names, F.count("stage3").alias("stage3_evaluated"), F.count("stage0").alias("accounted_candidates"))


def policy_effect(assessments: DataFrame, jobs: DataFrame, before: float, after: float) -> DataFrame:
    """Per job (pair_id, job): pairs, those eligible under either minimum, and those that the second leaves below it."""
    score = lambda m, name: coverage_scores(assessments, m).select("pair_id", F.col("eligible").alias(name))
    x = score(before, "was").join(score(after, "now"), "pair_id").join(jobs, "pair_id").groupBy("job")
    return x.agg(F.count("*").alias("pairs"), F.count_if("was").alias("before"), F.count_if("now").alias("after"), F.count_if(F.col("was") & ~F.col("now")).alias("below_minimum"))
