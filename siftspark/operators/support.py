"""What supports an assessment: claims against sources, what fits a prompt, which passages say the same, reasons to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import not_held
from .checks import quoted, squeezed

#: Fixed value: the categories that need evidence.
CATEGORIES = ("SKILLS", "EXPERIENCE", "PROJECTS", "EDUCATION")
NUMBER = r"\d+(?:\.\d+)?"


def claim_reason(claim: Column, quote: Column, source: Column, cited: Column) -> Column:
    """Why a claim is not supported, the first rule that it breaks; null where it is. cited: whether its citation is a good one of the assessment."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    return (
        F.when(~F.coalesce(cited, F.lit(False)), "INVALID_CLAIM_CITATION").when(blank(claim) | blank(quote), "EMPTY_CLAIM_SUPPORT")
        .when(F.contains(quote, F.lit("...")) | F.contains(quote, F.lit("…")), "ELLIPSIS_IN_QUOTE").when(~quoted(source, quote), "QUOTE_NOT_IN_SOURCE")
        .when(F.size(F.array_except(numbers(claim), numbers(quote))) > 0, "NUMERIC_CLAIM_NOT_IN_QUOTE")
    )


def fitting(groups: DataFrame, key: str, priority: str, size: str, budget: int) -> DataFrame:
    """Groups of each key that stay when whole ones are dropped from the last priority on until the rest fits."""
    w = Window.partitionBy(key).orderBy(priority).rowsBetween(Window.unboundedPreceding, 0)
    return groups.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def not_contained(retrieved: DataFrame, full: DataFrame, keys: list[str], own: str | None = None) -> DataFrame:
    """Retrieved passages (keys, text) that no full passage of the same keys holds between blanks, white space and case apart; own: rows of the same value don't count. Blank ones stay."""
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return not_held(retrieved, full, keys, own, squeezed, words, lambda source, passage: F.contains(spaced(source), spaced(passage)))


def review_reasons(pairs: DataFrame, checked: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each pair with its sorted distinct reasons: citations (pair_id, category, reason) that are not good, and categories without evidence (pair_id, category)."""
    bad = checked.where("reason is not null").select("pair_id", F.concat(F.lit("INVALID_CITATIONS:"), F.lower("category")).alias("reason"))
    have = evidence.groupBy("pair_id").agg(F.collect_set("category").alias("have"))
    missing = pairs.join(have, "pair_id", "left").select(
        "pair_id", F.explode(F.array_except(F.array(*map(F.lit, CATEGORIES)), F.coalesce("have", F.array().cast("array<string>")))).alias("category")
    )
    reasons = bad.union(missing.select("pair_id", F.concat(F.lit("MISSING_EVIDENCE:"), "category")))
    reasons = reasons.groupBy("pair_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return pairs.select("pair_id").join(reasons, "pair_id", "left").select("pair_id", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def judged(raw: Column, schema: str, score: str) -> Column:
    """struct<fields, status> of a judge's raw answer: a code fence around it goes; what is not a whole JSON object with a score is a failed evaluation."""
    clean = F.regexp_replace(raw, r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    fields = F.from_json(clean, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    ok = fields["_bad"].isNull() & fields[score].isNotNull()
    return F.struct(F.when(ok, fields).alias("fields"), F.when(ok, "PARSED").otherwise("EVALUATION_FAILED").alias("status"))
