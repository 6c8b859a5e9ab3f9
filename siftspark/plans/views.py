"""Queries on identities, histories, invariants, replays, searches and measures of them, with the same questions in DuckDB's words."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from siftspark.operators import evidence, retrieval, views
from siftspark.operators.cascade import outcome
from siftspark.sources.shared import shared_folder

from .catalogue import plan
from .relations import PAIRS, pairs, profiles, table
from .screening import LEXICAL


@plan(f"WITH {LEXICAL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'kept ' || doc_id ELSE lexical END AS lexical_text FROM l")
def lexical_backfill(spark, d):
    x = profiles(spark, d).withColumn("lexical_text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("kept "), "doc_id")))
    return x.select("doc_id", F.coalesce("lexical_text", retrieval.lexical(F.col("text"))).alias("lexical_text"))


@plan("""SELECT 'documents' AS "table", c_nationkey AS campaign, count(*) AS rows FROM customer GROUP BY ALL UNION ALL SELECT 'pairs', c_nationkey, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
UNION ALL SELECT 'jobs', n_nationkey, count(*) FROM nation GROUP BY ALL UNION ALL SELECT 'reviews', s_nationkey, count(*) FROM supplier GROUP BY ALL""")
def campaign_export(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "campaign")
    o = table(spark, d, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "campaign"), "o_custkey")
    tables = {"documents": c, "pairs": o, "jobs": table(spark, d, "nation").withColumnRenamed("n_nationkey", "campaign"), "reviews": table(spark, d, "supplier").withColumnRenamed("s_nationkey", "campaign")}
    return views.exported(tables, "campaign", f"{shared_folder(spark)}/export-{uuid.uuid4().hex}")


RULES, STATUSES = ("authorization", "experience", "education"), ("PASS", "REVIEW", "FAIL")


@plan(f"""WITH {PAIRS}, c AS (SELECT pair_id, [{', '.join(f"([{', '.join(map(repr, STATUSES))}])[pair_id // {3**k} % 3 + 1]" for k in range(3))}] AS s FROM pairs)
SELECT pair_id, list_contains(s, 'REVIEW') AS required, array_to_string(list_filter([{', '.join(f"CASE WHEN s[{k + 1}] = 'REVIEW' THEN '{r}' END" for k, r in enumerate(RULES))}], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def verification_view(spark, d):
    status = lambda k: F.element_at(F.array(*map(F.lit, STATUSES)), (F.floor(F.col("pair_id") / 3**k) % 3 + 1).cast("int"))
    checks = F.array(*[F.struct(F.lit(r).alias("rule"), status(k).alias("status"), F.lit(r.upper()).alias("code")) for k, r in enumerate(RULES)])
    x = pairs(spark, d).select("pair_id", views.verification(checks).alias("v"))
    return x.select("pair_id", "v.required", F.array_join(F.col("v.reasons.rule"), ",").alias("reasons"))


@plan(f"WITH {PAIRS} SELECT pair_id, sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), job, CASE WHEN pair_id % 4 = 0 THEN chr(30) ELSE status END)) AS id FROM pairs")
def stable_identity(spark, d):
    return pairs(spark, d).select("pair_id", views.identity(F.col("doc_id"), F.col("job"), F.when(F.col("pair_id") % 4 != 0, F.col("status"))).alias("id"))


@plan("""SELECT r.pair_id, place, handle, coalesce(citation, 'UNKNOWN_ID:' || handle) AS citation, coalesce(scope <> for_scope, false) AS rejected
FROM (SELECT o_orderkey AS pair_id, o_orderkey % 3 AS for_scope, unnest(['E1', 'E' || (o_orderkey % 9), 'S2']) AS handle, unnest([0, 1, 2]) AS place FROM orders) r
LEFT JOIN (SELECT DISTINCT l_orderkey AS pair_id, 'E' || l_linenumber AS handle, 'SKILLS:' || l_linenumber AS citation, (l_orderkey + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 3 AS scope FROM lineitem) k USING (pair_id, handle)""")
def selection_resolution(spark, d):
    k = F.col("o_orderkey")
    chosen = table(spark, d, "orders").select(k.alias("pair_id"), (k % 3).alias("scope"), F.array(F.lit("E1"), F.concat(F.lit("E"), (k % 9).cast("string")), F.lit("S2")).alias("handles"))
    known = table(spark, d, "lineitem").selectExpr("l_orderkey as pair_id", "concat('E', l_linenumber) as handle", "concat('SKILLS:', l_linenumber) as citation", "(l_orderkey + if(l_orderkey % 5 = 0, 1, 0)) % 3 as scope")
    return views.resolved(chosen, known.distinct())


STORED = """o AS (SELECT o_orderkey AS pair_id, (['SUCCESS', 'REVIEW_REQUIRED', 'EVALUATION_FAILED'])[o_orderkey % 3 + 1] AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS score, CASE WHEN o_orderkey % 7 < 4 THEN 'LOW_MATCH' END AS tier,
 CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 4 END AS n_categories, o_orderkey % 2 AS n_reasons, o_orderkey % 13 <> 0 AS raw, o_orderkey % 17 <> 0 AS verified, CASE WHEN o_orderkey % 4 = 0 THEN 'E' END AS error_code FROM orders)"""


@plan(f"""WITH {STORED}, v AS (SELECT pair_id, unnest([CASE WHEN f AND (score IS NOT NULL OR tier IS NOT NULL OR n_categories > 0) THEN 'FAILED_HAS_SCORE' END, CASE WHEN f AND error_code IS NULL THEN 'FAILED_WITHOUT_ERROR' END,
  CASE WHEN f AND (raw OR n_reasons > 0) THEN 'FAILED_HAS_ASSESSMENT' END, CASE WHEN NOT f AND (score IS NULL OR NOT raw) THEN 'DONE_WITHOUT_SCORE' END, CASE WHEN NOT f AND NOT verified THEN 'DONE_UNVERIFIED' END,
  CASE WHEN NOT f AND n_categories <> 4 THEN 'DONE_WITHOUT_CATEGORIES' END, CASE WHEN NOT f AND error_code IS NOT NULL THEN 'DONE_HAS_ERROR' END, CASE WHEN s AND tier IS NULL THEN 'SUCCESS_WITHOUT_TIER' END,
  CASE WHEN s AND n_reasons > 0 THEN 'SUCCESS_HAS_REASONS' END, CASE WHEN NOT f AND NOT s AND tier IS NOT NULL THEN 'REVIEW_HAS_TIER' END, CASE WHEN NOT f AND NOT s AND n_reasons = 0 THEN 'REVIEW_WITHOUT_REASONS' END]) AS rule
 FROM (SELECT *, status = 'EVALUATION_FAILED' AS f, status = 'SUCCESS' AS s FROM o)) SELECT * FROM v WHERE rule IS NOT NULL""")
def outcome_invariants(spark, d):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(F.lit("SUCCESS"), F.lit("REVIEW_REQUIRED"), F.lit("EVALUATION_FAILED")), (k % 3 + 1).cast("int"))
    x = table(spark, d, "orders").select(
        k.alias("pair_id"), status.alias("status"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("score"), F.when(k % 7 < 4, "LOW_MATCH").alias("tier"), F.when(k % 11 == 0, 3).otherwise(4).alias("n_categories"),
        (k % 2).alias("n_reasons"), (k % 13 != 0).alias("raw"), (k % 17 != 0).alias("verified"), F.when(k % 4 == 0, "E").alias("error_code"),
    )
    return views.broken_invariants(x)


OLD_NEW = {0: ("0.40", "0.30", "0.20", "0.10"), 1: ("0.25", "0.25", "0.25", "0.25")}


@plan("""WITH s AS (SELECT o_orderkey AS pair_id, o_custkey % 2 AS run, [o_orderkey * 7 % 101, o_orderkey * 13 % 101, o_orderkey * 29 % 101, o_orderkey * 31 % 101] AS c, o_orderkey % 4 <> 0 AS success FROM orders),
 r AS (SELECT *, CAST(CASE run WHEN 0 THEN 0.40 * c[1] + 0.30 * c[2] + 0.20 * c[3] + 0.10 * c[4] ELSE 0.25 * (c[1] + c[2] + c[3] + c[4]) END AS DECIMAL(5,2)) AS replayed FROM s)
SELECT pair_id, replayed, CASE WHEN NOT success THEN NULL WHEN replayed >= 75 THEN 'STRONG_MATCH' WHEN replayed >= 55 THEN 'POTENTIAL_MATCH' ELSE 'LOW_MATCH' END AS replayed_tier,
 pair_id % 5 <> 0 AND (CASE WHEN success THEN replayed < 55 ELSE false END OR (NOT success AND pair_id % 3 <> 0)) AS matches FROM r""")
def score_replay(spark, d):
    names = ("skills", "experience", "projects", "education")
    k = F.col("o_orderkey")
    scores = {n: k * m % 101 for n, m in zip(names, (7, 13, 29, 31), strict=True)}
    own = [F.when(F.col("o_custkey") % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("decimal(3,2)") for a, b in zip(OLD_NEW[0], OLD_NEW[1], strict=True)]
    stored = sum([s * w for s, w in zip(list(scores.values())[1:], own[1:], strict=True)], scores["skills"] * own[0])
    s = table(spark, d, "orders").select(
        k.alias("pair_id"), (F.col("o_custkey") % 2).alias("run"), F.when(k % 4 != 0, "SUCCESS").otherwise("REVIEW_REQUIRED").alias("status"),
        F.create_map(*[x for n in names for x in (F.lit(n), scores[n])]).alias("scores"), F.when(k % 5 == 0, -1).otherwise(stored).cast("decimal(5,2)").alias("score"),
        F.when((k % 4 != 0) | (k % 3 == 0), "LOW_MATCH").alias("tier"),
    )
    weights = F.create_map(*[x for n, w in zip(names, range(4), strict=True) for x in (F.lit(n), F.when(F.col("run") == 0, OLD_NEW[0][w]).otherwise(OLD_NEW[1][w]).cast("decimal(3,2)"))])
    return views.replayed_scores(s, s.select("run").distinct().withColumn("weights", weights))


@plan("""WITH e AS (SELECT l_orderkey AS pair_id, string_agg('S' || l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS new FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY l_orderkey)
SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN 'S0:PENDING,' ELSE '' END || new AS history FROM e""")
def stage_history(spark, d):
    e = table(spark, d, "lineitem").selectExpr("l_orderkey as pair_id", "l_linenumber as ord", "concat('S', l_linenumber) as stage", "l_returnflag as status").distinct()
    before = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("pair_id"), F.array(F.lit("S0:PENDING")).alias("history"))
    return views.histories(e, before).select("pair_id", F.array_join("history", ",").alias("history"))


@plan(f"""WITH {PAIRS} SELECT pair_id, sha256('{{"cap":15,"job":"' || job || '","pair":' || pair_id || ',"status":' || CASE WHEN pair_id % 6 = 0 THEN 'null' ELSE '"' || status || '"' END || '}}') AS hash, 'policy-2' AS policy FROM pairs""")
def policy_hash(spark, d):
    x = pairs(spark, d)
    h = views.canonical_hash(pair=F.col("pair_id"), job=F.col("job"), status=F.when(F.col("pair_id") % 6 != 0, F.col("status")), cap=F.lit(15))
    return x.select("pair_id", h.alias("hash"), F.lit("policy-2").alias("policy"))


@plan(f"""WITH {PAIRS}, f AS (SELECT doc_id, min(pair_id) AS pair_id FROM pairs GROUP BY doc_id)
SELECT doc_id, pair_id, CASE WHEN NOT eligible THEN 'FILTER_REJECTED' WHEN score >= 55 THEN 'SUCCESS' ELSE 'REVIEW_REQUIRED' END AS outcome, CASE WHEN doc_id % 2 = 0 THEN 'add ' || job END AS suggestions FROM f JOIN pairs USING (doc_id, pair_id)""")
def single_runs(spark, d):
    x = pairs(spark, d).groupBy("doc_id").agg(F.min_by(F.struct("pair_id", "job", "score", "eligible"), "pair_id").alias("p")).select("doc_id", "p.*")
    judged = F.when(F.col("score") >= 55, "SUCCESS").otherwise("REVIEW_REQUIRED")
    state = outcome(F.when(F.col("eligible"), "PASS").otherwise("FAIL"), F.lit(True), F.lit(1), 1, F.lit(False), judged)
    return x.select("doc_id", "pair_id", state.alias("outcome"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("add "), "job")).alias("suggestions"))


@plan(f"""WITH {PAIRS}, s AS (SELECT job, ([{', '.join(map(repr, ('WAITING', 'RUNNING', 'SUCCEEDED', 'FAILED')))}])[doc_id % 4 + 1] AS stage, status = 'SHORTLISTED' AND pair_id % 3 = 0 AS waits FROM pairs)
SELECT job, stage, count(*) AS n, count(*) FILTER (waits) AS retry_waiting FROM s GROUP BY ALL""")
def stage_counts(spark, d):
    stage = F.element_at(F.array(*map(F.lit, ("WAITING", "RUNNING", "SUCCEEDED", "FAILED"))), (F.col("doc_id") % 4 + 1).cast("int"))
    now, lease = F.lit(1), F.when(F.col("pair_id") % 3 == 0, 2).otherwise(0)
    x = pairs(spark, d).groupBy("job", stage.alias("stage"))
    return x.agg(F.count("*").alias("n"), F.count_if((F.col("status") == "SHORTLISTED") & (lease > now)).alias("retry_waiting"))


RESULT = """concat('{"score":', cast(pair_id % 90 as string), ',"citations":["A","B","C', cast(pair_id % 3 as string), '"],"registry":{"A":{"document":"d', cast(doc_id as string), '"},"C1":{"document":"x"}}}')"""


@plan(f"""WITH {PAIRS} SELECT pair_id, CASE WHEN pair_id % 10 <> 0 THEN CAST(pair_id % 90 AS DOUBLE) END AS score, status = 'SUCCESS' AND pair_id % 2 = 0 AS provisional,
 CASE WHEN pair_id % 10 = 0 THEN '' ELSE 'A=d' || doc_id || CASE WHEN pair_id % 3 = 1 THEN ',C1=x' ELSE '' END END AS evidence FROM pairs""")
def pair_view(spark, d):
    x = pairs(spark, d).select("pair_id", "status", (F.col("pair_id") % 2 == 0).alias("required"), F.when(F.col("pair_id") % 10 != 0, F.expr(RESULT)).alias("result"))
    return views.pair_views(x)


@plan(f"""WITH {PAIRS} SELECT pair_id, p.job, c_name AS name, upper(job) AS title, contains(lower(c_mktsegment), 'buil') OR contains(lower(c_name), 'buil') AS found, CASE WHEN pair_id % 5 = 0 THEN 'HOLD' ELSE 'UNREVIEWED' END AS decision
FROM pairs p JOIN customer ON doc_id = c_custkey""")
def pool_rows(spark, d):
    x = pairs(spark, d).select("pair_id", "doc_id", "job")
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    jobs = x.select("job").distinct().withColumn("title", F.upper("job"))
    reviews = x.where("pair_id % 5 = 0").select("pair_id", F.lit("HOLD").alias("decision"))
    return views.pool(x, docs, jobs, reviews, views.matches_text(" Buil ", "segment", "name")).select("pair_id", "job", "name", "title", "found", "decision")


@plan(f"""WITH {PAIRS}, o AS (SELECT pair_id, (['SUCCEEDED', 'RUNNING', 'FAILED'])[doc_id % 3 + 1] AS extraction, CASE WHEN pair_id % 6 = 5 THEN 'RUNNING' WHEN pair_id % 6 = 4 THEN 'STAGE3_RUNNING' ELSE status END AS status,
  CASE WHEN pair_id % 4 <> 0 THEN (['PASS', 'REVIEW', 'FAIL'])[pair_id % 3 + 1] END AS rules, pair_id % 5 < 3 AS matched, CASE WHEN pair_id % 7 = 0 THEN 'SUCCESS' END AS judged, 'F' || pair_id % 2 AS code FROM pairs),
 r AS (SELECT *, status = 'REVIEW_REQUIRED' AND judged IS NULL AND matched AS review, coalesce(rules IN ('PASS', 'REVIEW'), false) AS passed FROM o)
SELECT pair_id, 0 AS stage, CASE extraction WHEN 'RUNNING' THEN 'IN_PROGRESS' ELSE extraction END AS state, NULL AS reason FROM r UNION ALL
SELECT pair_id, 1, coalesce(rules, CASE WHEN extraction = 'SUCCEEDED' AND status = 'RUNNING' THEN 'IN_PROGRESS' ELSE 'NOT_REACHED' END), NULL FROM r UNION ALL
SELECT pair_id, 2, CASE WHEN review THEN 'REVIEW_REQUIRED' WHEN matched THEN 'COMPLETED' WHEN status = 'PROCESSING_FAILED' AND passed THEN 'FAILED' WHEN passed AND status = 'RUNNING' THEN 'IN_PROGRESS' ELSE 'NOT_REACHED' END,
 CASE WHEN review OR status = 'PROCESSING_FAILED' THEN code END FROM r UNION ALL
SELECT pair_id, 3, coalesce(judged, CASE WHEN review THEN 'NOT_REACHED' WHEN status = 'CUTOFF_EXCLUDED' THEN 'NOT_SELECTED' WHEN status = 'STAGE3_RUNNING' THEN 'IN_PROGRESS' WHEN status = 'SHORTLISTED' THEN 'QUEUED' ELSE 'NOT_REACHED' END),
 CASE WHEN status = 'EVALUATION_FAILED' THEN code END FROM r""")
def stage_labels(spark, d):
    k = F.col("pair_id")
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (key + 1).cast("int"))
    x = pairs(spark, d).select(
        "pair_id", pick(("SUCCEEDED", "RUNNING", "FAILED"), F.col("doc_id") % 3).alias("extraction"), F.when(k % 6 == 5, "RUNNING").when(k % 6 == 4, "STAGE3_RUNNING").otherwise(F.col("status")).alias("status"),
        F.when(k % 4 != 0, pick(("PASS", "REVIEW", "FAIL"), k % 3)).alias("rules"), (k % 5 < 3).alias("matched"), F.when(k % 7 == 0, "SUCCESS").alias("judged"), F.concat(F.lit("F"), (k % 2).cast("string")).alias("failure_code"),
    )
    return views.stage_labels(x)


@plan("""WITH c AS (SELECT n_nationkey AS campaign, [{'name': 'Old ' || n_name || '.doc', 'code': 'NOT_PDF'}, {'name': 'x' || n_nationkey || '.pdf', 'code': 'TOO_LARGE'}] AS rejected FROM nation WHERE n_regionkey IN (0, 2) OR n_nationkey % 7 = 0)
SELECT 'document' AS kind, c_nationkey AS campaign, c_name AS name, NULL AS reason FROM customer WHERE c_nationkey IN (SELECT campaign FROM c) AND contains(lower(c_name), '1')
UNION ALL SELECT 'rejected', campaign, r.name, r.code FROM (SELECT campaign, unnest(rejected) AS r FROM c) WHERE contains(lower(r.name), '1')""")
def global_search(spark, d):
    n = table(spark, d, "nation").where("n_regionkey in (0, 2) or n_nationkey % 7 = 0")  # owner's campaigns, and shared ones
    file = lambda name, code: F.struct(name.alias("name"), F.lit(code).alias("code"))
    rejected = F.array(file(F.concat(F.lit("Old "), "n_name", F.lit(".doc")), "NOT_PDF"), file(F.concat(F.lit("x"), "n_nationkey", F.lit(".pdf")), "TOO_LARGE"))
    docs = table(spark, d, "customer").select(F.col("c_nationkey").alias("campaign"), F.col("c_name").alias("name"))
    return views.global_search(docs, n.select(F.col("n_nationkey").alias("campaign"), rejected.alias("rejected")), "1")


@plan(f"""WITH {PAIRS}, b AS (SELECT doc_id, job, max(score) AS s FROM pairs GROUP BY ALL)
SELECT pair_id, coalesce((SELECT string_agg(b.job || '=' || format('{{:.1f}}', b.s), ',' ORDER BY b.job) FROM b WHERE b.doc_id = p.doc_id AND b.job <> p.job), '') AS roles FROM pairs p""")
def pair_roles(spark, d):
    return views.other_roles(pairs(spark, d).select("pair_id", "doc_id", "job", "score")).select("pair_id", "roles")


SAVED = '{"status": ["SUCCESS", "REVIEW_REQUIRED"], "score": {"from": 20, "to": null}, "eligible": true, "job": "h"}'


@plan(f"WITH {PAIRS} SELECT pair_id FROM pairs WHERE status IN ('SUCCESS', 'REVIEW_REQUIRED') AND score >= 20 AND eligible AND contains(lower(job), 'h')")
def saved_view(spark, d):
    return pairs(spark, d).where(views.saved_view(SAVED, {"status": str, "score": float, "eligible": bool, "job": str})).select("pair_id")


@plan(f"""WITH {PAIRS}, v AS (SELECT 'baseline' AS variant, job, pair_id, score, pair_id % 3 = 0 AS relevant FROM pairs UNION ALL SELECT 'focused', job, pair_id, score * 0.5::DOUBLE + applied * 4, pair_id % 3 = 0 FROM pairs),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, job ORDER BY score DESC, pair_id) AS n FROM v) WHERE n <= 15)
SELECT variant, job, count(*) AS chosen, count(*) FILTER (relevant) AS relevant, count(*) FILTER (pair_id IN (SELECT pair_id FROM t b WHERE b.variant = 'baseline' AND b.job = t.job)) AS kept, round(min(score), 6) AS boundary FROM t GROUP BY ALL""")
def variant_comparison(spark, d):
    p = pairs(spark, d).select("job", "pair_id", "score", (F.col("pair_id") % 3 == 0).alias("relevant"), "applied")
    base = p.select(F.lit("baseline").alias("variant"), "job", "pair_id", "score", "relevant")
    return views.variants(base.union(p.select(F.lit("focused"), "job", "pair_id", F.col("score") * 0.5 + F.col("applied") * 4, "relevant")), 15)


@plan("SELECT o_orderpriority AS job, o_orderkey AS pair_id FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0 EXCEPT ALL SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 89 = 0")
def pool_difference(spark, d):
    p = pairs(spark, d).select("job", "pair_id")
    rows = p.where("pair_id % 97 <> 0").withColumn("variant", F.lit("a")).union(p.where("pair_id % 89 <> 0").withColumn("variant", F.lit("b")))
    return views.pool_difference(rows, "a", "b")


@plan("""SELECT 'code' AS metric, (['MET', 'UNKNOWN', 'MISSING'])[l_partkey % 3 + 1] AS key, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL
UNION ALL SELECT m, key, CASE m WHEN 'least' THEN a WHEN 'largest' THEN b ELSE z END FROM (SELECT l_returnflag AS key, min(l_discount) AS a, max(l_discount) AS b, CAST(count(*) FILTER (l_discount = 0) AS DOUBLE) AS z FROM lineitem GROUP BY 1), (VALUES ('least'), ('largest'), ('zero')) t(m)
UNION ALL SELECT 'sparse_share', l_returnflag, round(avg((l_suppkey % 3 = 0)::INT), 6) FROM lineitem GROUP BY l_returnflag""")
def run_diagnostics(spark, d):
    x = table(spark, d, "lineitem")
    code = F.element_at(F.array(F.lit("MET"), F.lit("UNKNOWN"), F.lit("MISSING")), (F.col("l_partkey") % 3 + 1).cast("int"))
    scores = x.select(F.col("l_returnflag").alias("category"), F.col("l_discount").alias("score"))
    return views.diagnostics(x.select(code.alias("code")), scores, x.select(F.col("l_returnflag").alias("category"), (F.col("l_suppkey") % 3 == 0).alias("sparse")))


@plan(f"""WITH {PAIRS}, o AS (SELECT job, CASE WHEN pair_id % 13 <> 0 THEN score END AS score, pair_id % 6 = 0 OR pair_id % 8 = 3 AS doubt FROM pairs)
SELECT job, count(*) FILTER (score IS NULL) AS failed, count(*) FILTER (score IS NOT NULL AND doubt) AS review, count(*) FILTER (score IS NOT NULL AND NOT doubt) AS success, true AS scores_kept FROM o GROUP BY job""")
def verification_replay(spark, d):
    x = pairs(spark, d).select("job", "score", F.when(F.col("pair_id") % 13 != 0, F.col("score")).alias("now"), "pair_id")
    x = x.withColumn("o", evidence.outcome(F.col("now"), (F.col("pair_id") % 6 == 0).cast("int"), F.when(F.col("pair_id") % 8 == 3, "HIGH").otherwise("LOW")))
    n = lambda s: F.count_if(F.col("o.status") == s)
    return x.groupBy("job").agg(
        n("EVALUATION_FAILED").alias("failed"), n("REVIEW_REQUIRED").alias("review"), n("SUCCESS").alias("success"), F.bool_and(F.col("now").isNull() | (F.col("now") == F.col("score"))).alias("scores_kept")
    )


def overlap():
    """A stand-in for a scoring model: the share of the query's words that a text has."""

    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        words = [({*q.split(" ")} - {""}, {*t.split(" ")} - {""}) for q, t in zip(queries.str.lower(), texts.str.lower(), strict=True)]
        return pd.Series([len(q & t) / len(q) for q, t in words])

    return score


@plan("""WITH t AS (SELECT conv_id, turn, list_filter(list_distinct(string_split(lower(text), ' ')), lambda x: x <> '') AS w FROM conversations), q AS (SELECT conv_id, arg_min(w, turn) AS q FROM t GROUP BY conv_id)
SELECT conv_id, turn, round(len(list_intersect(w, q)) / len(q), 6) AS score FROM t JOIN q USING (conv_id)""")
def pair_scorer(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    q = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    return t.join(q, "conv_id").select("conv_id", "turn", F.round(retrieval.pair_scorer(overlap)("query", "text"), 6).alias("score"))


@plan("SELECT DISTINCT o_orderpriority AS job, o_orderstatus AS category, sha256('query ' || o_orderstatus || o_orderpriority) AS hash, CASE WHEN o_orderstatus = 'F' THEN 'CACHED' ELSE 'COMPUTE' END AS action FROM orders")
def query_cache(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderpriority").alias("job"), F.col("o_orderstatus").alias("category"), F.concat(F.lit("query "), "o_orderstatus", "o_orderpriority").alias("query"))
    cached = q.where("category = 'F'").select("job", "category", F.sha2("query", 256).alias("hash"), F.lit("m").alias("model"), F.lit("1").alias("version"))
    return retrieval.query_actions(q, cached, "m", "1").select("job", "category", "hash", "action")

