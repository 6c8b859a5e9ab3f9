"""Queries on exports, audits, counts and rates, with the same questions in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.functions.text import MAIL
from siftspark.operators import masking, measures, pages, ranking, reporting, skills
from siftspark.operators.ranking import TERMINAL

from .catalogue import plan
from .masking import CALLED
from .relations import PAIRS, PROFILES, pairs, profiles, table


@plan("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('batch:' || doc_id || ':' || source || '.pdf')::BLOB) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[strpos('0123456789abcdef', h[17]) % 4 + CASE WHEN strpos('0123456789abcdef', h[17]) % 4 = 0 THEN 4 ELSE 0 END] || h[18:20] || '-' || h[21:32] AS id FROM h""")
def document_ids(spark, d):
    name = F.concat(F.lit("batch:"), F.col("doc_id").cast("string"), F.lit(":"), "source", F.lit(".pdf"))
    return table(spark, d, "documents").select("doc_id", reporting.uuid5(name).alias("id"))


EXPORTED = ["candidate", "candidate_id", "role", "outcome", "score", "decision", "summary", "evidence", "questions", "reason", "notes", "tags", "reviewer", "reviewed"]


@plan(f"""WITH {PAIRS} SELECT 'file' || doc_id || '.pdf' AS candidate, CAST(doc_id AS VARCHAR) AS candidate_id, job AS role, status AS outcome, CASE WHEN pair_id % 5 = 0 THEN '' ELSE CAST(pair_id % 100 AS VARCHAR) END AS score, '''=HOLD' AS decision, '''  +1' AS summary,
 'a: MET; b: MISSING' AS evidence, CASE WHEN pair_id % 2 = 0 THEN '''-x' ELSE '' END AS questions, '' AS reason, '''@' || job AS notes, 'one, two' AS tags, 'r' || pair_id % 3 AS reviewer, '2024-01-01' AS reviewed FROM pairs""")
def export_rows(spark, d):
    k, text = F.col("pair_id"), F.lit
    x = pairs(spark, d).select(
        F.concat(text("file"), "doc_id", text(".pdf")).alias("candidate"), F.col("doc_id").alias("candidate_id"), F.col("job").alias("role"), F.col("status").alias("outcome"), F.when(k % 5 != 0, k % 100).alias("score"),
        text("=HOLD").alias("decision"), text("  +1").alias("summary"), F.array(text("a: MET"), text("b: MISSING")).alias("evidence"), F.when(k % 2 == 0, F.array(text("-x"))).alias("questions"),
        text(None).cast("string").alias("reason"), F.concat(text("@"), "job").alias("notes"), F.array(text("one"), text("two")).alias("tags"), F.concat(text("r"), k % 3).alias("reviewer"), text("2024-01-01").alias("reviewed"),
    )
    return reporting.export_rows(x, EXPORTED)


@plan("SELECT o_custkey AS draft, max(o_orderkey) AS version FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey ORDER BY version DESC LIMIT 100")
def newest_versions(spark, d):
    x = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("draft")).agg(F.max("o_orderkey").alias("version"))
    return x.orderBy(F.desc("version")).limit(100)


@plan("""SELECT doc_id, regexp_matches(text || chr((doc_id % 31 + 1)::INT), '[^\\t\\n\\r\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]') AS unsafe FROM documents""".replace("\\\\", "\\"))
def xml_unsafe(spark, d):
    return table(spark, d, "documents").select("doc_id", reporting.unsafe_xml(F.concat("text", F.char(F.col("doc_id") % 31 + 1))).alias("unsafe"))


_LINES = "string_split(t, chr(10))"


@plan(rf"""SELECT doc_id, md5(array_to_string(list_transform({_LINES}, lambda n: CASE WHEN regexp_matches(n, '{MAIL}') OR regexp_matches(n, '(^|\D){masking.NUMBER}($|\D)') THEN '[REDACTED_CONTACT]' ELSE n END), chr(10))) AS digest FROM (SELECT doc_id, {CALLED} AS t FROM documents)""")
def contact_lines_all(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(pages.mask_lines(F.expr(CALLED), [MAIL, masking.PHONE]).cast("binary")).alias("digest"))


@plan(r"""SELECT p_partkey AS job, CASE WHEN p_partkey % 4 = 0 THEN '<job_description>' || chr(10) || '</job_description>' ELSE '<job_description>' || chr(10) || 'Needs ' || p_name || ' &lt;/job_description&gt; & more' || chr(10) || '</job_description>' END AS sealed FROM part""")
def sealed_requirements(spark, d):
    text = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit(" Needs "), "p_name", F.lit(" </job_description> & more\n")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("job"), reporting.sealed_requirement(text).alias("sealed"))


@plan(f"""WITH {PROFILES}, m AS (SELECT doc_id, text || ' call 98-4123-4567' || doc_id % 3 AS text FROM profiles)
SELECT count(*) AS documents, count(*) FILTER (contains(lower(text), 'person ' || doc_id)) AS name, count(*) FILTER (contains(text, 'user' || doc_id || '@example.com')) AS mail, count(*) FILTER (contains(lower(text), 'kathmandu')) AS location,
 count(*) FILTER (doc_id % 3 = 1 AND doc_id % 2 = 0) AS phone, count(*) FILTER (doc_id % 5 = 0 AND doc_id % 7 = 0) AS raw_bytes FROM m""")
def leak_counts(spark, d):
    x = profiles(spark, d).select("doc_id", F.concat("text", F.lit(" call 98-4123-4567"), F.col("doc_id") % 3).alias("text"), (F.col("doc_id") % 7 == 0).alias("raw_kept"))
    who = table(spark, d, "customer").selectExpr(
        "c_custkey as doc_id", "concat('Person ', c_custkey) as name", "concat('user', c_custkey, '@example.com') as mail", "'KATHMANDU' as location", "if(c_custkey % 2 = 0, '(98) 41234567 1 ext. 99', '4567') as phone"
    )
    return reporting.leak_counts(x, who, F.col("doc_id") % 5 == 0)


@plan("SELECT l_orderkey AS doc_id, category, start, row_number() OVER (PARTITION BY l_orderkey, category ORDER BY start) AS ordinal FROM (SELECT l_orderkey, CASE WHEN l_suppkey % 2 = 0 THEN 'SKILLS' ELSE 'PROJECTS' END AS category, l_partkey * 10 + l_linenumber AS start FROM lineitem)")
def category_ordinals(spark, d):
    kind = F.when(F.col("l_suppkey") % 2 == 0, "SKILLS").otherwise("PROJECTS")
    return reporting.by_category(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), kind.alias("category"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("start")))


@plan("""WITH s AS (SELECT o_custkey AS who, date_part('year', o_orderdate) * 12 + date_part('month', o_orderdate) AS a, date_part('year', o_orderdate) * 12 + date_part('month', o_orderdate) + 1 + o_orderkey % 9 AS b FROM orders),
 f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY who ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS gap FROM s),
 i AS (SELECT *, sum(gap) OVER (PARTITION BY who ORDER BY a, b RANGE UNBOUNDED PRECEDING) AS island FROM f),
 m AS (SELECT who, CAST(sum(n) AS BIGINT) AS months, count(*) AS islands FROM (SELECT who, island, max(b) - min(a) AS n FROM i GROUP BY ALL) GROUP BY who)
SELECT who, months, round(months / 12, 2) AS years, round((months + islands) / 12, 2) AS most_years FROM m""")
def experience_months(spark, d):
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("who"), month.alias("a"), (month + 1 + F.col("o_orderkey") % 9).alias("b"))
    return reporting.experience(ranking.merged_intervals(o, "who", "a", "b"))


@plan("""SELECT event_id AS draft, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 30 MINUTE THEN 'FAILED' WHEN event_type = 'click' THEN 'PROCESSING' ELSE 'READY' END AS status,
 CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 30 MINUTE THEN 'PROCESSING_TIMEOUT' END AS error FROM events""")
def stale_drafts(spark, d):
    x = table(spark, d, "events").select(F.col("event_id").alias("draft"), F.when(F.col("event_type") == "click", "PROCESSING").otherwise("READY").alias("status"), F.col("ts").alias("updated"))
    return reporting.stale_drafts(x, F.expr("timestamp '2024-01-15'"), 30).drop("updated")


@plan(f"""WITH {PAIRS}, c AS (SELECT n_nationkey AS campaign, n_name || '_50%' AS name FROM nation), n AS (SELECT c_nationkey AS campaign, count(*) AS docs FROM customer GROUP BY 1)
SELECT campaign, name, coalesce(docs, 0) AS docs, (SELECT count(*) FROM c WHERE contains(lower(name), '_50%') AND campaign % 2 = 0) AS total FROM c LEFT JOIN n USING (campaign) WHERE contains(lower(name), '_50%') AND campaign % 2 = 0 ORDER BY campaign DESC LIMIT 5 OFFSET 2""")
def campaign_page(spark, d):
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("campaign"), F.concat("n_name", F.lit("_50%")).alias("name"))
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("campaign")).agg(F.count("*").alias("docs"))
    x = c.where(F.contains(F.lower("name"), F.lit("_50%")) & (F.col("campaign") % 2 == 0)).join(n, "campaign", "left").fillna(0, ["docs"])
    return reporting.page(x, [F.desc("campaign")], 2, 5)


@plan(f"WITH {PAIRS} SELECT pair_id, status, score, (SELECT count(*) FROM pairs WHERE status = 'CUTOFF_EXCLUDED') AS total FROM pairs WHERE status = 'CUTOFF_EXCLUDED' ORDER BY score DESC, pair_id LIMIT 20 OFFSET 20")
def outcome_page(spark, d):
    x = pairs(spark, d).where("status = 'CUTOFF_EXCLUDED'").select("pair_id", "status", "score")
    return reporting.page(x, [F.desc("score"), F.col("pair_id")], 20, 20)


@plan(f"""WITH {PAIRS}, t AS (SELECT DISTINCT job, t AS target_id FROM pairs, (VALUES (0), (1), (2)) v(t)), a AS (SELECT job, pair_id, pair_id % 3 AS target_id, CASE pair_id % 4 WHEN 0 THEN 'MET' WHEN 1 THEN 'MISSING' ELSE 'PARTIAL' END AS state FROM pairs)
SELECT job, target_id, state, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT t.job, t.target_id, 'UNASSESSED', count(*) FROM t JOIN pairs p USING (job) WHERE p.pair_id % 3 <> t.target_id GROUP BY ALL""")
def requirement_grid(spark, d):
    p = pairs(spark, d).select("job", "pair_id")
    k = F.col("pair_id")
    a = p.select("job", "pair_id", (k % 3).alias("target_id"), F.when(k % 4 == 0, "MET").when(k % 4 == 1, "MISSING_INFORMATION").otherwise("PARTIAL").alias("status"))
    targets = p.select("job").distinct().select("job", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("target_id"))
    return reporting.requirement_grid(p, targets, a)


@plan("""WITH e AS (SELECT event_type AS provider, 'm' || user_id % 2 AS model, value AS latency, CASE WHEN event_id % 3 <> 0 THEN 'v' || event_id % 3 END AS resolved FROM events),
 r AS (SELECT provider, model, string_agg(resolved || '=' || n, ',' ORDER BY resolved) AS resolved FROM (SELECT provider, model, resolved, count(*) AS n FROM e WHERE resolved IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT provider, model, count(latency) AS count, round(avg(latency), 3) AS mean, round(quantile_cont(latency, 0.5), 3) AS p50, round(quantile_cont(latency, 0.95), 3) AS p95, round(max(latency), 3) AS max, any_value(r.resolved) AS resolved FROM e JOIN r USING (provider, model) GROUP BY ALL""")
def provider_models(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_type").alias("provider"), F.concat(F.lit("m"), F.col("user_id") % 2).alias("model"), F.col("value").alias("latency"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("v"), F.col("event_id") % 3)).alias("resolved")
    )
    return reporting.providers(e)


@plan("SELECT CASE WHEN count(*) FILTER (event_id % 7 = 0) = count(*) FILTER (event_id % 3 <> 0) AND count(*) > 0 THEN 0 END AS reported_cost, round(sum(value) FILTER (event_id % 7 = 0), 6) AS partial_cost FROM events")
def reported_costs(spark, d):
    return reporting.reported_costs(table(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, F.col("value")).alias("cost"), (F.col("event_id") % 3 != 0).alias("with_usage")))


@plan("""WITH s AS (SELECT event_id // 5 AS moment, event_type AS container, value AS cpu, value * 2 AS memory FROM events), l AS (SELECT 'cpu' AS metric, container, cpu AS v FROM s UNION ALL SELECT 'memory', container, memory FROM s UNION ALL SELECT 'memory', NULL, sum(memory) FROM s GROUP BY moment)
SELECT metric, container, count(*) AS count, round(avg(v), 3) AS mean, round(quantile_cont(v, 0.5), 3) AS p50, round(quantile_cont(v, 0.95), 3) AS p95, round(max(v), 3) AS max FROM l GROUP BY ALL""")
def resource_use(spark, d):
    return reporting.resources(table(spark, d, "events").selectExpr("floor(event_id / 5) as at", "event_type as container", "value as cpu", "value * 2 as memory"))


@plan(f"""WITH {PAIRS}, o AS (SELECT CASE WHEN pair_id % 3 = 0 THEN 'shortlist' ELSE 'no' END AS label, CASE pair_id % 5 WHEN 0 THEN 'shortlist' WHEN 1 THEN 'review' WHEN 2 THEN 'error' ELSE 'no' END AS decision FROM pairs)
SELECT count(*) AS n, round(count(*) FILTER (label = 'shortlist' AND decision = 'shortlist') / count(*) FILTER (decision = 'shortlist'), 6) AS precision, round(count(*) FILTER (label = 'shortlist' AND decision = 'shortlist') / count(*) FILTER (label = 'shortlist'), 6) AS recall,
 round(count(*) FILTER (decision = 'review') / count(*), 6) AS reviews, round(count(*) FILTER (decision = 'error') / count(*), 6) AS errors FROM o""")
def decision_rates(spark, d):
    k = F.col("pair_id")
    decision = F.when(k % 5 == 0, "shortlist").when(k % 5 == 1, "review").when(k % 5 == 2, "error").otherwise("no")
    return reporting.rates(pairs(spark, d).select(F.when(k % 3 == 0, "shortlist").otherwise("no").alias("label"), decision.alias("decision")))


@plan(f"""WITH {PAIRS}, s AS (SELECT job, pair_id, CASE WHEN pair_id % 4 = 0 THEN 0 ELSE score END AS score, pair_id % 3 = 0 AS relevant FROM pairs), t AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, pair_id) AS n FROM s)
SELECT job, count(*) AS pairs, count(*) FILTER (score = 0) AS zero, count(*) FILTER (n <= 15) AS selected, count(*) FILTER (n <= 15 AND score = 0) AS selected_zero, count(*) FILTER (n <= 15 AND NOT relevant) AS unrelated FROM t GROUP BY job""")
def replay_counts(spark, d):
    x = pairs(spark, d).select("job", "pair_id", F.when(F.col("pair_id") % 4 == 0, 0.0).otherwise(F.col("score")).alias("score"), (F.col("pair_id") % 3 == 0).alias("relevant"))
    return reporting.replay_counts(x, 15)


@plan(f"""WITH {PAIRS}, s AS (SELECT job, pair_id, score AS relevance, pair_id % 5 = 0 AS expected_fail, applied >= 3 AS selected FROM pairs), i AS (SELECT pair_id FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY relevance DESC, pair_id) AS n FROM s WHERE NOT expected_fail) WHERE n <= 15)
SELECT job, count(*) AS selected, count(*) FILTER (pair_id IN (SELECT pair_id FROM i)) AS overlap, count(*) FILTER (expected_fail) AS expected_fail FROM s WHERE selected GROUP BY job""")
def benchmark_overlap(spark, d):
    return reporting.benchmark_overlap(pairs(spark, d).select("job", "pair_id", F.col("score").alias("relevance"), (F.col("pair_id") % 5 == 0).alias("expected_fail"), (F.col("applied") >= 3).alias("selected")), 15)


@plan(f"WITH {PAIRS} SELECT job, CASE WHEN score < 0 THEN NULL WHEN score < 55 THEN '0-55' WHEN score < 75 THEN '55-75' WHEN score < 101 THEN '75-101' END AS band, count(*) AS n FROM pairs GROUP BY ALL")
def score_bands(spark, d):
    return pairs(spark, d).groupBy("job", reporting.bands(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@plan(r"""WITH s AS (SELECT strlen(text) AS before, strlen(regexp_replace(text, '\s+', ' ', 'g')) AS after FROM documents WHERE strlen(text) > 0)
SELECT count(*) AS pairs, min(before) AS before_least, max(before) AS before_most, min(after) AS after_least, max(after) AS after_most, round(avg(after), 0) AS mean_after, round(round(avg(round((before - after) * 100.0::DOUBLE / before, 1)), 6), 1) AS mean_reduction FROM s""")
def size_summary(spark, d):
    t = table(spark, d, "documents").where("octet_length(text) > 0")
    return reporting.size_summary(t.select(F.octet_length("text").alias("before"), F.octet_length(F.regexp_replace("text", r"\s+", " ")).alias("after")))


@plan("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 4 = 0 THEN 'PROVIDER_DAILY_TOKEN_LIMIT' ELSE 'PROVIDER_RATE_LIMITED' END WHEN 1 THEN 'PROVIDER_UNAVAILABLE' WHEN 2 THEN 'PROVIDER_CONFIGURATION' WHEN 3 THEN 'INVALID_OUTPUT' END AS error FROM events""")
def provider_errors(spark, d):
    k = F.col("event_id")
    status = F.when(k % 6 == 0, 429).when(k % 6 == 1, 503).when(k % 6 == 2, 401).otherwise(200)
    limit = measures.limit_error(F.when(k % 4 == 0, "tokens per day").otherwise("slow down"))["error_code"]
    return table(spark, d, "events").select("event_id", reporting.provider_error(status, limit, k % 6 != 3).alias("error"))


@plan(f"""WITH {PAIRS} SELECT count(*) FILTER (status NOT IN ({', '.join(f"'{s}'" for s in TERMINAL)}) AND pair_id % 10 <> 0) AS missing, count(*) FILTER (status IN ({', '.join(f"'{s}'" for s in TERMINAL)}) AND pair_id % 10 = 0) AS repeated, 1 AS unexpected FROM pairs""")
def public_lists(spark, d):
    p = pairs(spark, d).select(F.col("pair_id").alias("id"), "status")
    other = p.where("id % 10 = 0").select("id").union(p.agg(F.lit(-1).cast("long").alias("id")))
    return reporting.same_ids(p, {"terminal": p.where(F.col("status").isin(*TERMINAL)).select("id"), "other": other})


@plan("""WITH c AS (SELECT l_orderkey AS pair_id, CASE WHEN l_partkey % 50 = 0 THEN l_orderkey + 1 ELSE l_orderkey END AS owner, (['SKILLS', 'EDUCATION'])[l_suppkey % 2 + 1] AS category, (['SKILLS', 'PROJECTS', 'EDUCATION', 'CONTEXT'])[l_partkey % 4 + 1] AS source, l_linenumber AS chunk_id, l_returnflag AS text FROM lineitem)
SELECT DISTINCT pair_id, chunk_id, 'FOREIGN_OWNER' AS fault FROM c WHERE owner <> pair_id UNION ALL SELECT DISTINCT pair_id, chunk_id, 'BAD_SOURCE' FROM c WHERE source <> 'CONTEXT' AND NOT (category = 'SKILLS' AND source IN ('SKILLS', 'PROJECTS')) AND NOT (category = 'EDUCATION' AND source = 'EDUCATION')
UNION ALL SELECT pair_id, chunk_id, 'CONFLICT' FROM c GROUP BY ALL HAVING count(DISTINCT text) > 1""")
def registry_faults(spark, d):
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    x = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"), F.when(F.col("l_partkey") % 50 == 0, F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey")).alias("owner"), pick(("SKILLS", "EDUCATION"), "l_suppkey").alias("category"),
        pick(("SKILLS", "PROJECTS", "EDUCATION", "CONTEXT"), "l_partkey").alias("source"), F.col("l_linenumber").alias("chunk_id"), F.col("l_returnflag").alias("text"),
    )
    return reporting.registry_faults(x, skills.SCOPES)


@plan(f"WITH {PAIRS} SELECT status, CASE WHEN pair_id % 3 = 0 THEN 'E' || pair_id % 2 END AS failure_code, count(*) AS pairs, CAST(sum(pair_id % 4) AS BIGINT) AS attempts FROM pairs GROUP BY ALL")
def failure_groups(spark, d):
    k = F.col("pair_id")
    return reporting.failure_groups(pairs(spark, d).select("status", F.when(k % 3 == 0, F.concat(F.lit("E"), k % 2)).alias("failure_code"), (k % 4).alias("attempts")))
