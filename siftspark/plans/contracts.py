"""Queries on contracts and full pool filters, with the same questions in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators.contracts import broken_rules, matching_all

from .catalogue import plan
from .relations import PAIRS, pairs, table


@plan("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 31 = 0 THEN 'same' WHEN p_partkey % 37 = 0 THEN ' ' ELSE 'j' || p_partkey END AS job FROM part),
 b AS (SELECT job, unnest([CASE WHEN k % 5 = 1 THEN 'YEARS_NOT_A_NUMBER' END, CASE WHEN k % 5 = 2 THEN 'YEARS_OUT_OF_RANGE' END, CASE WHEN job = ' ' THEN 'BLANK_JOB' END, CASE WHEN k % 7 = 0 THEN 'BLANK_TITLE' END,
  CASE WHEN k % 9 = 0 THEN 'BLANK_TERM' END, CASE WHEN k % 10 = 0 THEN 'TERM_TOO_LONG' END, CASE WHEN k % 4 = 0 THEN 'TERMS_WITHOUT_DEGREE' END, CASE WHEN k % 4 <> 1 THEN 'ALIAS_OF_OTHER_LEVEL' END, CASE WHEN k % 6 = 0 THEN 'WRONG_CATEGORIES' END,
  CASE WHEN k % 6 = 1 THEN 'BLANK_QUERY' END, CASE WHEN k % 8 = 0 THEN 'TOO_MANY_TARGETS' END, CASE WHEN k % 8 = 0 OR k % 12 = 0 THEN 'TARGET_ID_TWICE' END, CASE WHEN k % 11 = 0 THEN 'BAD_EVIDENCE_TERMS' END, CASE WHEN k % 13 = 0 THEN 'DOMAIN_NOT_PREFERENCE' END,
  CASE WHEN k % 3 = 0 THEN 'MINIMUM_OUT_OF_RANGE' END]) AS rule FROM p)
SELECT job, rule FROM b WHERE rule IS NOT NULL UNION ALL SELECT job, 'JOB_TWICE' FROM p GROUP BY job HAVING count(*) > 1""")
def contract_rules(spark, d):
    k = F.col("p_partkey")
    target = lambda n, kind, group: F.struct(F.lit(n).alias("id"), kind.alias("kind"), F.lit("requirement").alias("treatment"), F.array(group).alias("groups"))
    group = F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("spark")))
    first = target("t1", F.when(k % 13 == 0, "domain").otherwise(F.lit("skill")), group)
    targets = F.when(k % 8 == 0, F.array_repeat(first, 49)).when(k % 12 == 0, F.array(first, first)).otherwise(F.array(first, target("t2", F.lit("skill"), F.array(F.lit("x")))))
    terms = F.concat(F.array(F.lit("science")), F.when(k % 9 == 0, F.array(F.lit(" "))).otherwise(F.array().cast("array<string>")), F.when(k % 10 == 0, F.array(F.repeat(F.lit("y"), F.lit(121)))).otherwise(F.array().cast("array<string>")))
    named = lambda c, v: (F.lit(c), v)
    queries = F.create_map(
        *named("SKILLS", F.lit("spark")), *named("EXPERIENCE", F.when(k % 6 == 1, " ").otherwise(F.lit("x"))), *named("PROJECTS", F.lit("x")), F.when(k % 6 == 0, "OTHER").otherwise(F.lit("EDUCATION")), F.lit("x")
    )
    x = table(spark, d, "part").select(
        F.when(k % 31 == 0, "same").when(k % 37 == 0, " ").otherwise(F.concat(F.lit("j"), k)).alias("job"), F.when(k % 7 == 0, "").otherwise(F.lit("title")).alias("title"),
        F.when(k % 5 == 1, -1.0).when(k % 5 == 2, 101.0).otherwise(3.0).alias("years"), (k % 4).cast("int").alias("level_rank"), terms.alias("terms"), F.array(F.lit(1)).alias("alias_ranks"), queries.alias("queries"),
        targets.alias("targets"), F.when(k % 3 == 0, 1.5).otherwise(0.5).alias("minimum"),
    )
    return broken_rules(x)


SETS = {
    "search": {"text": " HI "}, "state": {"status": "SUCCESS", "decision": "HOLD"}, "score": {"score": {"from": 20, "to": 60}}, "category": {"category": {"name": "skills", "from": 50}}, "years": {"years": {"to": 5}},
    "unknown": {"unknown": ["years"]}, "check": {"check": {"rule": "education", "status": "FAIL"}}, "all": {"requirements": {"ids": ["r1", "r2"]}}, "any": {"requirements": {"ids": ["r1", "r3"], "state": "UNASSESSED", "of": "any"}},
    "review": {"to_review": True}, "reason": {"reasons": "DATE"}, "tag": {"tag": "Hot"}, "people": {"assignee": "a1", "reviewer": "v0"}, "after": {"reviewed": {"from": "2024-01-05"}}, "none": {},
}


@plan(f"""WITH {PAIRS}, p AS (SELECT *, pair_id AS k, CASE WHEN pair_id % 5 <> 0 THEN pair_id % 12 END AS years, CASE WHEN pair_id % 7 <> 0 THEN score END AS s FROM pairs),
 f AS (SELECT unnest([CASE WHEN contains(lower(job), 'hi') THEN 'search' END, CASE WHEN status = 'SUCCESS' AND k % 2 = 0 THEN 'state' END, CASE WHEN s BETWEEN 20 AND 60 THEN 'score' END, CASE WHEN k % 3 <> 0 AND k % 101 >= 50 THEN 'category' END, CASE WHEN years <= 5 THEN 'years' END,
  CASE WHEN years IS NULL THEN 'unknown' END, CASE WHEN k % 4 = 1 THEN 'check' END, CASE WHEN k % 6 = 0 THEN 'all' END, 'any', CASE WHEN k % 9 = 0 OR status = 'REVIEW_REQUIRED' THEN 'review' END,
  CASE WHEN k % 8 = 0 THEN 'reason' END, CASE WHEN k % 10 = 0 THEN 'tag' END, CASE WHEN k % 3 = 1 AND k % 2 = 0 THEN 'people' END, CASE WHEN k % 11 <> 0 AND k % 9 + 1 >= 5 THEN 'after' END, 'none']) AS name, k FROM p)
SELECT name, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids FROM f WHERE name IS NOT NULL GROUP BY name""")
def pool_filters(spark, d):
    k = F.col("pair_id")
    check = lambda rule, status: F.struct(F.lit(rule).alias("rule"), status.alias("status"))
    x = pairs(spark, d).select(
        "pair_id", F.col("job").alias("text"), "status", F.when(k % 2 == 0, "HOLD").otherwise("UNREVIEWED").alias("decision"), F.when(k % 7 != 0, F.col("score")).alias("score"), F.when(k % 5 != 0, k % 12).alias("years"),
        F.when(k % 3 != 0, F.create_map(F.lit("skills"), k % 101)).otherwise(F.create_map(F.lit("projects"), k)).alias("category_scores"),
        F.array(check("education", F.when(k % 4 == 1, "FAIL").otherwise(F.lit("PASS"))), check("skill", F.lit("FAIL"))).alias("checks"),
        F.create_map(F.lit("r1"), F.when(k % 2 == 0, "DIRECT").otherwise(F.lit("PARTIAL")), F.lit("r2"), F.when(k % 3 == 0, "DIRECT").otherwise(F.lit("MISSING"))).alias("requirements"), (k % 9 == 0).alias("needs_review"),
        F.when(k % 8 == 0, "date precision").alias("reasons"), F.when(k % 10 == 0, F.array(F.lit("hot"))).otherwise(F.array(F.lit("cold"))).alias("tags"), F.concat(F.lit("a"), k % 3).alias("assignee"),
        F.concat(F.lit("v"), k % 2).alias("reviewer"), F.when(k % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 9).cast("int"))).alias("reviewed"),
    )
    hit = F.array_compact(F.array(*[F.when(matching_all(asked), name) for name, asked in SETS.items()]))
    return x.select("pair_id", F.explode(hit).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.sum("pair_id").alias("ids"))
