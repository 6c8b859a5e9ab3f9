"""Views of stored outcomes: identities, histories, invariants, replays, searches and measures of them."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cascade import pool_filter
from .scoring import tier

#: What stands between and for missing parts of an identity; the rule behind an unknown citation.
BETWEEN, MISSING, UNKNOWN = "\x1f", "\x1e", "UNKNOWN_ID:"


def identity(*parts: Column) -> Column:
    """A stable identity of some parts, null ones included."""
    return F.sha2(F.concat_ws(BETWEEN, *[F.coalesce(p.cast("string"), F.lit(MISSING)) for p in parts]), 256)


def canonical_hash(**parts: Column) -> Column:
    """The hash of a record as JSON with its names in order, without blanks."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def verification(checks: Column) -> Column:
    """struct<required, reasons>: the checks (array of rule, status, code) that ask for a review, kept as reasons."""
    reasons = F.filter(checks, lambda c: c["status"] == "REVIEW")
    return F.struct((F.size(reasons) > 0).alias("required"), reasons.alias("reasons"))


def resolved(selected: DataFrame, registry: DataFrame) -> DataFrame:
    """Selections (pair_id, scope, handles) against the registry (pair_id, handle, citation, scope): place, handle, citation, rejected.

    A handle that the pair's registry does not hold stays, marked unknown; a selection made for another scope is rejected.
    """
    s = selected.select("pair_id", F.col("scope").alias("for_scope"), F.posexplode("handles").alias("place", "handle"))
    x = s.join(registry.select("pair_id", "handle", "citation", F.col("scope").alias("of_scope")), ["pair_id", "handle"], "left")
    citation = F.coalesce("citation", F.concat(F.lit(UNKNOWN), "handle"))
    return x.select("pair_id", "place", "handle", citation.alias("citation"), F.coalesce(F.col("of_scope") != F.col("for_scope"), F.lit(False)).alias("rejected"))


def broken_invariants(outcomes: DataFrame) -> DataFrame:
    """Outcomes (pair_id, status, score, tier, n_categories, n_reasons, raw, verified, error_code) to (pair_id, rule) for each rule that one breaks."""
    failed, done, success = F.col("status") == "EVALUATION_FAILED", F.col("status") != "EVALUATION_FAILED", F.col("status") == "SUCCESS"
    rules = {
        "FAILED_HAS_SCORE": failed & (F.col("score").isNotNull() | F.col("tier").isNotNull() | (F.col("n_categories") > 0)), "FAILED_WITHOUT_ERROR": failed & F.col("error_code").isNull(),
        "FAILED_HAS_ASSESSMENT": failed & (F.col("raw") | (F.col("n_reasons") > 0)), "DONE_WITHOUT_SCORE": done & (F.col("score").isNull() | ~F.col("raw")), "DONE_UNVERIFIED": done & ~F.col("verified"),
        "DONE_WITHOUT_CATEGORIES": done & (F.col("n_categories") != 4), "DONE_HAS_ERROR": done & F.col("error_code").isNotNull(), "SUCCESS_WITHOUT_TIER": success & F.col("tier").isNull(),
        "SUCCESS_HAS_REASONS": success & (F.col("n_reasons") > 0), "REVIEW_HAS_TIER": done & ~success & F.col("tier").isNotNull(), "REVIEW_WITHOUT_REASONS": done & ~success & (F.col("n_reasons") == 0),
    }
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    return outcomes.select("pair_id", F.explode(broken).alias("rule"))


def replayed_scores(stored: DataFrame, weights: DataFrame) -> DataFrame:
    """Stored (pair_id, run, status, scores map, score, tier) with the score and tier that its run's weights (run, weights map) give, and whether both are as stored.

    Weights are decimals; halves round up. Only successes have a tier. The weights have a row for each run and go to all tasks: a shuffle by run would make a task of each run.
    """
    x = stored.join(F.broadcast(weights), "run")
    part = lambda k: F.col("scores")[k].cast("decimal(20,12)") * F.col("weights")[k]
    total = F.aggregate(F.map_keys("weights"), F.lit(0).cast("decimal(38,14)"), lambda s, k: (s + part(k)).cast("decimal(38,14)"))
    score = F.round(total, 2).cast("decimal(5,2)")
    again = F.when(F.col("status") == "SUCCESS", tier(score))
    return x.select("pair_id", score.alias("replayed"), again.alias("replayed_tier"), ((score == F.col("score")) & again.eqNullSafe(F.col("tier"))).alias("matches"))


def histories(events: DataFrame, before: DataFrame) -> DataFrame:
    """(pair_id, ord, stage, status) appended, in order, to the history that a pair has (pair_id, history): nothing of it changes."""
    new = events.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("ord", "stage", "status"))).alias("new"))
    steps = F.transform("new", lambda e: F.concat_ws(":", e["stage"], e["status"]))
    return new.join(before, "pair_id", "left").select("pair_id", F.concat(F.coalesce("history", F.array().cast("array<string>")), steps).alias("history"))


#: Fixed value: what is said of a pair beyond its job's limit.
BEYOND = "Outside this role's detailed assessment limit; not a recruiter rejection."


def stage_labels(pairs: DataFrame, full: bool = False) -> DataFrame:
    """(pair_id, extraction, status, rules, matched, judged, failure_code) to the observed state of each stage, with reason: one row for each stage.

    full: with the error of the extraction (extraction_error), the messages of checks that did not pass, in their order (checks: array of
    status and message), and what is said of pairs beyond the limit.
    """
    status, rules = F.col("status"), F.col("rules")
    passed, ready = rules.isin("PASS", "REVIEW"), F.col("extraction") == "SUCCEEDED"
    review = (status == "REVIEW_REQUIRED") & F.col("judged").isNull() & F.col("matched")
    first = F.when(F.col("extraction") == "RUNNING", "IN_PROGRESS").otherwise(F.col("extraction"))
    second = F.coalesce(rules, F.when(ready & (status == "RUNNING"), "IN_PROGRESS").otherwise("NOT_REACHED"))
    third = (
        F.when(review, "REVIEW_REQUIRED").when(F.col("matched"), "COMPLETED").when((status == "PROCESSING_FAILED") & passed, "FAILED")
        .when(passed & (status == "RUNNING"), "IN_PROGRESS").otherwise("NOT_REACHED")
    )
    waits = F.when(review, "NOT_REACHED").when(status == "CUTOFF_EXCLUDED", "NOT_SELECTED").when(status == "STAGE3_RUNNING", "IN_PROGRESS").when(status == "SHORTLISTED", "QUEUED")
    fourth = F.coalesce("judged", waits.otherwise("NOT_REACHED"))
    none = F.lit(None).cast("string")
    why = (none, none, F.when(review | (status == "PROCESSING_FAILED"), F.col("failure_code")), F.when(status == "EVALUATION_FAILED", F.col("failure_code")))
    if full:
        open_checks = F.filter(F.coalesce("checks", F.array()), lambda c: ~F.coalesce(c["status"] == "PASS", F.lit(False)))
        messages = F.array_join(F.transform(open_checks, lambda c: F.coalesce(c["message"], F.lit(""))), "; ")
        why = (F.col("extraction_error"), messages, why[2], F.when(status == "CUTOFF_EXCLUDED", BEYOND).otherwise(why[3]))
    steps = [F.struct(F.lit(k).alias("stage"), s.alias("state"), w.alias("reason")) for k, (s, w) in enumerate(zip((first, second, third, fourth), why, strict=True))]
    return pairs.select("pair_id", F.explode(F.array(*steps)).alias("s")).select("pair_id", "s.*")


def pair_views(pairs: DataFrame) -> DataFrame:
    """(pair_id, status, required, result as JSON) to score, provisional, and the citations that the registry knows, as citation=document."""
    kind = "score double, citations array<string>, registry map<string, struct<document: string>>"
    r = F.from_json("result", kind)
    known = F.filter(r["citations"], lambda c: F.map_contains_key(r["registry"], c))
    shown = F.transform(known, lambda c: F.concat_ws("=", c, F.try_element_at(r["registry"], c)["document"]))
    provisional = (F.col("status") == "SUCCESS") & F.col("required")
    return pairs.select("pair_id", r["score"].alias("score"), provisional.alias("provisional"), F.array_join(F.coalesce(shown, F.array().cast("array<string>")), ",").alias("evidence"))


def matches_text(term: str, *columns: str) -> Column:
    """Whether a text is part of any of the columns, in any case, as it stands; the empty one is part of all."""
    parts = [F.coalesce(F.contains(F.lower(c), F.lit(term.strip().lower())), F.lit(False)) for c in columns]
    return F.lit(True) if not term.strip() else reduce(or_, parts)


def pool(pairs: DataFrame, docs: DataFrame, jobs: DataFrame, reviews: DataFrame, found: Column) -> DataFrame:
    """Pairs with their document and job, the review that they may have, and whether a search finds the document. No column of texts goes past the scan but in that flag."""
    d = docs.withColumn("found", found)
    r = reviews.withColumnRenamed("decision", "reviewed")
    x = pairs.join(d, "doc_id").join(F.broadcast(jobs), "job").join(r, "pair_id", "left")  # one row a job
    return x.withColumn("decision", F.coalesce("reviewed", F.lit("UNREVIEWED"))).drop("reviewed")


def global_search(docs: DataFrame, campaigns: DataFrame, term: str) -> DataFrame:
    """Documents (campaign, name) of campaigns (campaign, rejected: array of name, code) that a text finds, and the rejected files that it finds there: kind, campaign, name, reason."""
    found = docs.join(campaigns.select("campaign"), "campaign", "left_semi").where(matches_text(term, "name"))
    files = campaigns.select("campaign", F.explode("rejected").alias("r")).select("campaign", "r.name", "r.code").where(matches_text(term, "name"))
    return found.select(F.lit("document").alias("kind"), "campaign", "name", F.lit(None).cast("string").alias("reason")).union(files.select(F.lit("rejected"), "campaign", "name", "code"))


def other_roles(pairs: DataFrame) -> DataFrame:
    """Adds roles to (pair_id, doc_id, job, score): the other jobs of the pair's document, each with its best score, as job=score, to one place by the score's exact value, halves to even. A document has as many as there are jobs at most."""
    best = pairs.groupBy("doc_id", "job").agg(F.max("score").alias("score"))
    roles = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("job", "score"))).alias("roles"))
    others = F.filter("roles", lambda r: r["job"] != F.col("job"))
    x = pairs.join(roles, "doc_id")
    return x.withColumn("roles", F.array_join(F.transform(others, lambda r: F.concat(r["job"], F.lit("="), F.call_function("format_number", r["score"], F.lit("0.0")))), ","))


def saved_view(spec: str, allowed: dict[str, type]) -> Column:
    """The condition of a stored filter: a JSON object of {column: value, list or {"from", "to"}}; names and kinds of values are checked first."""
    given = json.loads(spec)
    if not isinstance(given, dict) or (unknown := sorted(set(given) - set(allowed))):
        raise ValueError(f"not a filter on {sorted(allowed)}: {unknown if isinstance(given, dict) else given}")
    out = {}
    for name, value in given.items():
        whole = [v for v in value.values() if v is not None] if isinstance(value, dict) else value if isinstance(value, list) else [value]
        if not all(isinstance(v, allowed[name]) or (allowed[name] is float and type(v) is int) for v in whole):
            raise ValueError(f"{name} asks for {allowed[name].__name__}")
        out[name] = (value.get("from"), value.get("to")) if isinstance(value, dict) else value
    return pool_filter(out)


def variants(scored: DataFrame, cap: int) -> DataFrame:
    """(variant, job, pair_id, score, relevant) over one pool: the first cap of each variant and job, how many are relevant, and how many the variant 'baseline' has too."""
    w = Window.partitionBy("variant", "job").orderBy(F.desc("score"), "pair_id")
    top = scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
    base = top.where("variant = 'baseline'").select("job", "pair_id", F.lit(1).alias("also"))
    x = top.join(base, ["job", "pair_id"], "left").groupBy("variant", "job")
    return x.agg(F.count("*").alias("chosen"), F.count_if("relevant").alias("relevant"), F.count("also").alias("kept"), F.round(F.min("score"), 6).alias("boundary"))


def pool_difference(scored: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of one variant that another lacks, either way: none where the pools are the same."""
    of = lambda v: scored.where(F.col("variant") == v).select("job", "pair_id")
    return of(first).exceptAll(of(second)).union(of(second).exceptAll(of(first)))


def diagnostics(checks: DataFrame, scores: DataFrame, hits: DataFrame) -> DataFrame:
    """metric, key, value: how often each check code stands, least, largest and zero scores of each category, and the share of retrieved chunks with a sparse hit."""
    codes = checks.groupBy(F.col("code").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit("code").alias("metric"), "key", "value")
    c = scores.groupBy("category").agg(F.min("score").alias("least"), F.max("score").alias("largest"), F.count_if(F.col("score") == 0).alias("zero"))
    c = c.select(F.col("category").alias("key"), F.expr("stack(3, 'least', least, 'largest', largest, 'zero', cast(zero as double)) as (metric, value)")).select("metric", "key", "value")
    share = hits.groupBy(F.col("category").alias("key")).agg(F.round(F.avg(F.col("sparse").cast("double")), 6).alias("value")).select(F.lit("sparse_share").alias("metric"), "key", "value")
    return codes.union(c).union(share)


def exported(tables: dict[str, DataFrame], key: str, folder: str) -> DataFrame:
    """Writes the tables, each parted by the key's values, and reads them again: table, key, rows."""
    out = None
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(key).parquet(f"{folder}/{name}")
        x = df.sparkSession.read.parquet(f"{folder}/{name}").groupBy(key).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), key, "rows")
        out = x if out is None else out.union(x)
    return out

