"""Queries on notes, support, confirmed facts, sorted pools, counters and policies, with the same questions in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators import coverage, outcomes

from .catalogue import plan
from .relations import PAIRS, pairs, table
from .screening import TARGETS

STATUSES = ("PASS", "REVIEW", "FAIL")


@plan(f"""WITH {PAIRS}, c AS (SELECT pair_id, [([{', '.join(map(repr, STATUSES))}])[pair_id % 3 + 1], ([{', '.join(map(repr, STATUSES))}])[pair_id // 3 % 3 + 1]] AS s FROM pairs)
SELECT pair_id, CASE WHEN list_contains(s, 'FAIL') THEN 'FAIL' WHEN list_contains(s, 'REVIEW') THEN 'REVIEW' ELSE 'PASS' END AS status,
 array_to_string(list_filter([CASE WHEN s[1] = 'FAIL' THEN 'm0' END, CASE WHEN s[2] = 'FAIL' THEN 'm1' END], lambda x: x IS NOT NULL), ',') AS failed, array_to_string(list_filter([CASE WHEN s[1] = 'REVIEW' THEN 'm0' END, CASE WHEN s[2] = 'REVIEW' THEN 'm1' END], lambda x: x IS NOT NULL), ',') AS review,
 pair_id % 20 AS years FROM c""")
def rule_notes(spark, d):
    k = F.col("pair_id")
    status = lambda n: F.element_at(F.array(*map(F.lit, STATUSES)), (F.floor(k / n) % 3 + 1).cast("int"))
    checks = F.array(*[F.struct(status(3**n).alias("status"), F.lit(f"m{n}").alias("message")) for n in (0, 1)])
    x = pairs(spark, d).select("pair_id", outcomes.rule_summary(checks, F.struct((k % 20).alias("years"))).alias("r"))
    return x.select("pair_id", "r.status", F.array_join("r.failed", ",").alias("failed"), F.array_join("r.review", ",").alias("review"), "r.metrics.years")


SOURCE = "Built 3 payment APIs in Java. Never used Kafka."
#: claim, quote, whether the citation is good, evidence id, and the reason.
CASES = (
    ("Built 3 payment APIs", "Built 3 payment APIs", True, "e1", None), ("x", "Built", False, "e1", "INVALID_CLAIM_CITATION"), (" ", "Built", True, "e1", "EMPTY_CLAIM_SUPPORT"),
    ("Built", "Built ... Java", True, None, "ELLIPSIS_IN_QUOTE"), ("Built", "Rebuilt", True, "e1", "QUOTE_NOT_IN_SOURCE"), ("Built", "Built", True, "e2", "INVALID_EVIDENCE_ID"),
    ("used Kafka", "used Kafka", True, "e1", "CLAIM_NOT_EXPLICIT_IN_SOURCE"), ("made 4 APIs", "payment APIs", True, None, "NUMERIC_CLAIM_NOT_IN_QUOTE"), ("made APIs", "payment  apis", True, None, None),
)


@plan(f"SELECT o_orderkey AS pair_id, ([{', '.join('NULL' if c[4] is None else repr(c[4]) for c in CASES)}])[o_orderkey % {len(CASES)} + 1] AS reason FROM orders")
def support_reasons(spark, d):
    pick = lambda n: F.element_at(F.array(*[F.lit(c[n]) for c in CASES]), (F.col("o_orderkey") % len(CASES) + 1).cast("int"))
    reason = outcomes.support_reason(pick(0), pick(1), F.lit(SOURCE), pick(2), pick(3), F.lit("e1"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), reason.alias("reason"))


@plan(f"""WITH {PAIRS} SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN 'experience' ELSE '' END AS cleared, CASE WHEN pair_id % 3 = 0 THEN 'education' ELSE 'experience,education' END AS open, status = 'SUCCESS' AS provisional FROM pairs WHERE pair_id % 2 = 0
UNION ALL SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN 'experience' ELSE '' END, CASE WHEN pair_id % 3 = 0 THEN '' ELSE 'experience' END, status = 'SUCCESS' AND pair_id % 3 <> 0 FROM pairs WHERE pair_id % 2 = 1""")
def confirmed_facts(spark, d):
    k = F.col("pair_id")
    x = pairs(spark, d).select(
        "pair_id", "status", F.when(k % 2 == 0, F.array(F.lit("experience"), F.lit("education"))).otherwise(F.array(F.lit("experience"))).alias("reasons"),
        F.create_map(F.lit("experience"), F.when(k % 3 == 0, "PASS").otherwise("FAIL")).alias("verified"),
    )
    return outcomes.confirmed(x).select("pair_id", F.array_join("cleared", ",").alias("cleared"), F.array_join("open", ",").alias("open"), "provisional")


KEYS = ("name", "updated", "experience", "score", "skills", "projects", "education")


@plan(f"""WITH {PAIRS}, p AS (SELECT pair_id, job AS name, CASE WHEN pair_id % 7 <> 0 THEN status END AS updated, CASE WHEN pair_id % 5 <> 0 THEN pair_id % 40 END AS experience, score, CASE WHEN pair_id % 3 = 0 THEN applied END AS skills, responsibility AS projects, CASE WHEN pair_id % 11 = 0 THEN pair_id % 101 END AS education FROM pairs)
{' UNION ALL '.join(f"SELECT key, pair_id FROM (SELECT '{k}' AS key, pair_id FROM p ORDER BY {k} DESC NULLS LAST, pair_id LIMIT 30)" for k in KEYS)}""")
def sorted_pages(spark, d):
    k = F.col("pair_id")
    x = pairs(spark, d).select(
        "pair_id", F.col("job").alias("name"), F.when(k % 7 != 0, F.col("status")).alias("updated"), F.when(k % 5 != 0, k % 40).alias("experience"), "score", F.when(k % 3 == 0, F.col("applied")).alias("skills"),
        F.col("responsibility").alias("projects"), F.when(k % 11 == 0, k % 101).alias("education"),
    )
    return outcomes.sorted_pages(x, list(KEYS), True, 30)


_STAGE = {s: [o for o in some if (s, o) != ("stage3", "evaluated")] for s, some in outcomes.STAGES.items()}


@plan(f"""WITH {PAIRS}, o AS (SELECT {', '.join(f"CASE WHEN pair_id % {n + 2} <> 1 OR {n} = 0 THEN ([{', '.join(map(repr, os))}])[pair_id % {len(os)} + 1] END AS {s}" for n, (s, os) in enumerate(_STAGE.items()))} FROM pairs)
SELECT count(*) AS total_input_candidates, {', '.join(f"count(*) FILTER ({s} = '{o}') AS {s}_{o}" for s, os in _STAGE.items() for o in os)}, count(stage3) AS stage3_evaluated, count(stage0) AS accounted_candidates FROM o""")
def run_counters(spark, d):
    k = F.col("pair_id")
    one = lambda n, os: F.when((k % (n + 2) != 1) | F.lit(n == 0), F.element_at(F.array(*map(F.lit, os)), (k % len(os) + 1).cast("int")))
    return outcomes.run_counters(pairs(spark, d).select(*[one(n, os).alias(s) for n, (s, os) in enumerate(_STAGE.items())]))


def _eligible(least: float) -> str:
    return f"supported > 0 AND (asked = 0 OR proved > 0) AND sc > 0 AND sc >= {least}"


@plan(f"""WITH {TARGETS}, c AS (SELECT pair_id, category, sum(importance * coverage) FILTER (treatment <> 'preference') / sum(importance) FILTER (treatment <> 'preference') AS main,
  sum(importance * coverage) FILTER (treatment = 'preference') / sum(importance) FILTER (treatment = 'preference') AS extra FROM t GROUP BY ALL),
 s AS (SELECT pair_id, sum(w * CASE WHEN extra IS NULL THEN main ELSE least(1, main + 0.1::DOUBLE * extra) END) / sum(w) AS score FROM
  (SELECT *, CASE category WHEN 'SKILLS' THEN 0.3::DOUBLE WHEN 'EXPERIENCE' THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END AS w FROM c WHERE main IS NOT NULL) GROUP BY pair_id),
 p AS (SELECT pair_id, count(*) FILTER (treatment <> 'preference' AND coverage > 0) AS supported, count(*) FILTER (kind <> 'skill' AND treatment <> 'preference') AS asked,
  count(*) FILTER (kind <> 'skill' AND treatment <> 'preference' AND ((coverage = 1 AND NOT sub) OR sub OR (coverage >= 0.5 AND n_groups >= 2))) AS proved FROM t GROUP BY pair_id),
 e AS (SELECT *, round(round(coalesce(score, 0), 9), 6) AS sc FROM p LEFT JOIN s USING (pair_id)), b AS (SELECT pair_id % 4 AS job, {_eligible(0.25)} AS was, {_eligible(0.5)} AS now FROM e)
SELECT job, count(*) AS pairs, count(*) FILTER (was) AS before, count(*) FILTER (now) AS after, count(*) FILTER (was AND NOT now) AS below_minimum FROM b GROUP BY job""")
def policy_effect(spark, d):
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    cover, sub = F.col("l_quantity").cast("long") % 5 / 4, F.col("l_partkey") % 17 == 0
    a = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"), pick(list(coverage.WEIGHTS), "l_partkey").alias("category"), pick(("skill", "responsibility", "project"), "l_suppkey").alias("kind"),
        F.when(F.col("l_suppkey") % 5 == 0, "preference").otherwise("requirement").alias("treatment"), (1 + F.col("l_linenumber") % 3).alias("importance"), cover.alias("coverage"),
        F.when((cover == 1) & ~sub, "DIRECT").otherwise("PARTIAL").alias("status"), sub.alias("accepted_substitute"), (F.col("l_linenumber") % 4).alias("n_groups"),
    )
    jobs = a.select("pair_id", (F.col("pair_id") % 4).alias("job")).distinct()
    return outcomes.policy_effect(a, jobs, 0.25, 0.5)
