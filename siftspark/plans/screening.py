"""Queries on sections, rules, retrieval, coverage, evidence and states, with the same questions in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators import coverage, evidence, lifecycle, measures, retrieval, rules, sections
from siftspark.operators.ranking import TERMINAL

from .catalogue import plan
from .relations import PAIRS, PROFILES, pairs, profiles, table

ONE_OF = ", ".join(f"'{s}'" for s in TERMINAL)
_ANY = sections.heading_pattern()
_NAMED = " ".join(f"WHEN regexp_full_match(h, '(?i)(?:{sections.heading_pattern(s)})') THEN '{s}'" for s in sections.HEADINGS)
SECTIONS = rf"""{PROFILES}, marked AS (SELECT doc_id, string_split(regexp_replace(text, '(?im)^[#*=\-\s]*({_ANY})[:\s\-*=#]*$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM profiles),
 part AS (SELECT doc_id, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM marked),
 named AS (SELECT doc_id, pos, CASE WHEN pos = 0 AND n > 1 THEN 'SUMMARY' WHEN pos = 0 THEN 'EXPERIENCE' {_NAMED.replace('(h,', '(string_split(part, chr(2))[1],')} END AS section,
  trim(CASE WHEN pos = 0 THEN part ELSE string_split(part, chr(2))[2] END, chr(10) || chr(9) || chr(13) || ' ') AS content FROM part),
 sections AS (SELECT doc_id, section, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS content FROM named WHERE content <> '' GROUP BY doc_id, section)"""


@plan(f"WITH {SECTIONS} SELECT doc_id, section, content FROM sections")
def section_parse(spark, d):
    return sections.sections(profiles(spark, d))


@plan(f"WITH {SECTIONS} SELECT CASE section WHEN 'SUMMARY' THEN 'EXPERIENCE' WHEN 'CERTIFICATIONS' THEN 'EDUCATION' ELSE section END AS category, count(DISTINCT doc_id) AS docs, CAST(sum(length(content)) AS BIGINT) AS chars FROM sections GROUP BY 1")
def category_map(spark, d):
    x = sections.sections(profiles(spark, d))
    kind = F.element_at(F.create_map(*[F.lit(v) for kv in sections.CATEGORY.items() for v in kv]), F.col("section"))
    return x.groupBy(kind.alias("category")).agg(F.count_distinct("doc_id").alias("docs"), F.sum(F.length("content")).alias("chars"))


@plan(r"""WITH RECURSIVE b AS (SELECT doc_id, trim(u, chr(10) || chr(9) || chr(13) || ' ') AS block, i FROM
  (SELECT doc_id, unnest(p) AS u, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\n\s*[-•*]\s*|\n\n+|\n(\d+\.\s)', chr(1) || '\1', 'g'), chr(1)) AS p FROM documents))),
 c AS (SELECT doc_id, i, CASE WHEN length(block) <= 578 THEN [block] ELSE regexp_extract_all(block, '(?s)\S.{0,577}( |$)|\S.{577}') END AS cut FROM b WHERE length(block) > 5),
 q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n, trim(piece, chr(10) || chr(9) || chr(13) || ' ') AS piece FROM (SELECT doc_id, i, unnest(cut) AS piece, generate_subscripts(cut, 1) AS j FROM c)),
 f AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, '' AS pending, CAST(NULL AS VARCHAR) AS body FROM (SELECT DISTINCT doc_id FROM q) UNION ALL
  SELECT doc_id, n, CASE WHEN length(joined) > 578 THEN piece WHEN length(joined) >= 150 THEN '' ELSE joined END, CASE WHEN length(joined) > 578 THEN pending WHEN length(joined) >= 150 THEN joined END
  FROM (SELECT q.doc_id, q.n, q.piece, f.pending, CASE WHEN f.pending = '' THEN q.piece ELSE f.pending || ' ' || q.piece END AS joined FROM f JOIN q ON q.doc_id = f.doc_id AND q.n = f.n + 1)),
 o AS (SELECT doc_id, n, body FROM f WHERE body IS NOT NULL UNION ALL SELECT doc_id, n + 1, pending FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS r FROM f) WHERE r = 1 AND pending <> '')
SELECT doc_id, 'EXPERIENCE' AS section, 'EXPERIENCE' AS category, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index, '[Section: EXPERIENCE] ' || body AS text, length(body) AS char_length FROM o""")
def structural_chunks(spark, d):
    return sections.chunks(table(spark, d, "documents").select("doc_id", F.lit("EXPERIENCE").alias("section"), F.col("text").alias("content")))


@plan(r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])[ \t\r\f\v]+\s*([A-Z])', '\1' || chr(10) || '\2', 'g'), ';', chr(10), 'g'), chr(10)) AS p FROM documents),
 u AS (SELECT doc_id, trim(unnest(p), chr(9) || chr(13) || chr(12) || chr(11) || ' ') AS passage FROM p)
SELECT doc_id, count(*) AS passages, max(length(passage)) AS longest FROM u WHERE passage <> '' GROUP BY doc_id""")
def passage_split(spark, d):
    x = sections.passages(table(spark, d, "documents").select("doc_id", "text"))
    return x.groupBy("doc_id").agg(F.count("*").alias("passages"), F.max(F.length("passage")).alias("longest"))


SPELT = (" Bachelor's. ", "b.sc", "MBA", "ph.d.", "12th", "Wizard", "master", "high school")


@plan(f"""SELECT c_custkey AS doc_id, CASE WHEN v IN ('BACHELOR''S') THEN 'BACHELOR' WHEN v = 'PH.D' THEN 'PHD' WHEN v = 'WIZARD' THEN NULL ELSE v END AS degree,
 CASE v WHEN 'BACHELOR''S' THEN 4 WHEN 'B.SC' THEN 4 WHEN 'MBA' THEN 5 WHEN 'PH.D' THEN 6 WHEN '12TH' THEN 2 WHEN 'MASTER' THEN 5 WHEN 'HIGH SCHOOL' THEN 1 END AS rank
FROM (SELECT c_custkey, rtrim(upper(trim(([{', '.join("'" + s.replace("'", "''") + "'" for s in SPELT)}])[c_custkey % {len(SPELT)} + 1])), '.') AS v FROM customer)""")
def degree_rank(spark, d):
    spelt = F.element_at(F.array(*map(F.lit, SPELT)), (F.col("c_custkey") % len(SPELT) + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), rules.degree(spelt).alias("degree"), rules.degree_rank(spelt).alias("rank"))


FACTS = """facts AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 11 END AS override, CASE WHEN c_custkey % 4 <> 0 THEN floor(c_acctbal / 1000) END AS supplied,
 CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 13 END AS extracted, CASE c_custkey % 3 WHEN 0 THEN 'eligible' WHEN 1 THEN 'ineligible' END AS auth, CASE WHEN c_custkey % 2 = 0 THEN 'recruiter_verified' ELSE 'cv_extracted' END AS auth_source FROM customer),
 jobs AS (SELECT * FROM (VALUES ('backend', 3, true), ('data', 0, false), ('lead', 8, true), ('test', 2, false)) AS j(job, least, require_auth))"""


def facts(spark, d):
    """Documents' facts and four profiles: every pair of both (the profiles are four rows)."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(
        k.alias("doc_id"), F.when(k % 7 == 0, (k % 11).cast("double")).alias("override"), F.when(k % 4 != 0, F.floor(F.col("c_acctbal") / 1000).cast("double")).alias("supplied"),
        F.when(k % 5 == 0, (k % 13).cast("double")).alias("extracted"), F.when(k % 3 == 0, "eligible").when(k % 3 == 1, "ineligible").alias("auth"),
        F.when(k % 2 == 0, "recruiter_verified").otherwise("cv_extracted").alias("auth_source"),
    )
    jobs = F.array(*[F.struct(F.lit(j).alias("job"), F.lit(y).alias("least"), F.lit(a).alias("require_auth")) for j, y, a in (("backend", 3, True), ("data", 0, False), ("lead", 8, True), ("test", 2, False))])
    return c.withColumn("fact", rules.effective(F.col("override"), F.col("supplied"), F.col("extracted"))).withColumn("j", F.explode(jobs)).select("*", "j.*")


@plan(f"""WITH {FACTS} SELECT doc_id, coalesce(override, supplied, extracted) AS years,
 CASE WHEN override IS NOT NULL THEN 'recruiter_verified' WHEN supplied IS NOT NULL THEN 'supplied' WHEN extracted IS NOT NULL THEN 'cv_extracted' ELSE 'unknown' END AS source FROM facts""")
def effective_facts(spark, d):
    return facts(spark, d).where("job = 'data'").select("doc_id", F.col("fact.value").alias("years"), F.col("fact.source").alias("source"))


@plan(f"""WITH {FACTS}, x AS (SELECT *, coalesce(override, supplied, extracted) AS years, CASE WHEN override IS NOT NULL THEN 'recruiter_verified' ELSE 'x' END AS source FROM facts, jobs),
 c AS (SELECT doc_id, job, CASE WHEN NOT require_auth THEN 'AUTHORIZATION_NOT_REQUIRED' WHEN auth IS NULL THEN 'AUTHORIZATION_UNKNOWN' WHEN auth_source <> 'recruiter_verified' THEN 'AUTHORIZATION_UNVERIFIED'
   WHEN auth = 'ineligible' THEN 'AUTHORIZATION_INELIGIBLE' ELSE 'AUTHORIZATION_ELIGIBLE' END AS auth_code,
  CASE WHEN least = 0 THEN 'EXPERIENCE_NOT_REQUIRED' WHEN years IS NULL THEN 'EXPERIENCE_UNKNOWN' WHEN years < least AND override IS NULL AND supplied IS NULL AND years + 1 >= least THEN 'EXPERIENCE_DATE_PRECISION'
   WHEN years < least THEN 'INSUFFICIENT_EXPERIENCE' WHEN source <> 'recruiter_verified' THEN 'EXPERIENCE_UNVERIFIED' ELSE 'EXPERIENCE_MET' END AS experience_code FROM x)
SELECT *, CASE WHEN auth_code = 'AUTHORIZATION_INELIGIBLE' OR experience_code = 'INSUFFICIENT_EXPERIENCE' THEN 'FAIL'
 WHEN auth_code IN ('AUTHORIZATION_NOT_REQUIRED', 'AUTHORIZATION_ELIGIBLE') AND experience_code IN ('EXPERIENCE_NOT_REQUIRED', 'EXPERIENCE_MET') THEN 'PASS' ELSE 'REVIEW' END AS status FROM c""")
def rule_checks(spark, d):
    years, source = F.col("fact.value"), F.col("fact.source")
    upper = F.when(source == "cv_extracted", years + 1)
    x = facts(spark, d).select(
        "doc_id", "job", rules.authorization_check(F.col("require_auth"), F.col("auth"), F.col("auth_source")).alias("auth_code"),
        rules.experience_check(F.col("least"), years, source, upper).alias("experience_code"),
    )
    return x.withColumn("status", rules.overall(F.array("auth_code", "experience_code")))


CONCEPTS = [
    ("javascript", "required", ("techjavascript",)), ("dotnet", "required", ("techdotnet", "techcsharp")), ("sql", "required", ("sql", "techpostgresql")),
    ("kubernetes", "preferred", ("techkubernetes",)), ("apis", "context", ("rest apis", "payment apis")), ("reports", "context", ("reporting system",)),
]
LEXICAL = rf"""{PROFILES}, l AS (SELECT doc_id, array_to_string(regexp_extract_all({'regexp_replace(' * 6}lower(text), 'java[\s._-]*script', 'techjavascript', 'g'), '\bk8s\b', 'techkubernetes', 'g'), '\bkubernetes\b', 'techkubernetes', 'g'),
  '\bpostgres\b', 'techpostgresql', 'g'), '\bnode[\s._-]*js\b', 'technodejs', 'g'), '\bc#', 'techcsharp', 'g'), '[a-z0-9]+'), ' ') AS lexical FROM profiles)"""
LEXICAL = LEXICAL.replace("lower(text)", "replace(lower(text), ' .net', ' techdotnet')")


@plan(f"WITH {LEXICAL} SELECT doc_id, lexical FROM l")
def lexical_normalize(spark, d):
    return profiles(spark, d).select("doc_id", retrieval.lexical(F.col("text")).alias("lexical"))


def _has(*phrases: str) -> str:
    return "(" + " OR ".join(f"contains(p, ' {x} ')" for x in phrases) + ")::INT"


_HITS = ", ".join(f"{' + '.join(_has(*ph) for _, kind, ph in CONCEPTS if kind == k)} AS {k}" for k in retrieval.PRIORITIES)


@plan(f"""WITH {LEXICAL}, h AS (SELECT doc_id % 25 AS pool, doc_id AS id, {_HITS} FROM (SELECT doc_id, ' ' || lexical || ' ' AS p FROM l))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY required DESC, preferred DESC, context DESC, id) AS sparse_rank FROM h WHERE required + preferred + context > 0) WHERE sparse_rank <= 10""")
def sparse_topk(spark, d):
    texts = profiles(spark, d).select((F.col("doc_id") % 25).alias("pool"), F.col("doc_id").alias("id"), retrieval.lexical(F.col("text")).alias("lexical"))
    return retrieval.sparse_top(texts, CONCEPTS, 10, ("pool",)).drop("lexical")


@plan("""WITH q AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label),
 s AS (SELECT label, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 4) AS score FROM embeddings JOIN q USING (label))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS dense_rank FROM s) WHERE dense_rank <= 10""")
def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return retrieval.dense_top(e.select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v")), queries, "label")


TARGETS = """t AS (SELECT l_orderkey AS pair_id, (['SKILLS', 'EXPERIENCE', 'PROJECTS', 'EDUCATION'])[l_partkey % 4 + 1] AS category, (['skill', 'responsibility', 'project'])[l_suppkey % 3 + 1] AS kind,
 CASE WHEN l_suppkey % 5 = 0 THEN 'preference' ELSE 'requirement' END AS treatment, 1 + l_linenumber % 3 AS importance, CAST(l_quantity AS BIGINT) % 5 / 4 AS coverage, l_partkey % 17 = 0 AS sub, l_linenumber % 4 AS n_groups FROM lineitem)"""


@plan(f"""WITH {TARGETS}, c AS (SELECT pair_id, category, sum(importance * coverage) FILTER (treatment <> 'preference') / sum(importance) FILTER (treatment <> 'preference') AS main,
  sum(importance * coverage) FILTER (treatment = 'preference') / sum(importance) FILTER (treatment = 'preference') AS extra FROM t GROUP BY ALL),
 s AS (SELECT pair_id, sum(w * CASE WHEN extra IS NULL THEN main ELSE least(1, main + 0.1::DOUBLE * extra) END) / sum(w) AS score FROM
  (SELECT *, CASE category WHEN 'SKILLS' THEN 0.3::DOUBLE WHEN 'EXPERIENCE' THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END AS w FROM c WHERE main IS NOT NULL) GROUP BY pair_id),
 p AS (SELECT pair_id, count(*) FILTER (treatment <> 'preference' AND coverage > 0) AS supported, coalesce(sum(coverage) FILTER (kind = 'responsibility'), 0) AS responsibility_coverage,
  coalesce(sum(coverage) FILTER (kind = 'project'), 0) AS applied_coverage, count(*) FILTER (kind <> 'skill' AND treatment <> 'preference') AS asked,
  count(*) FILTER (kind <> 'skill' AND treatment <> 'preference' AND ((coverage = 1 AND NOT sub) OR sub OR (coverage >= 0.5 AND n_groups >= 2))) AS proved FROM t GROUP BY pair_id),
 e AS (SELECT *, round(round(coalesce(score, 0), 9), 6) AS sc, supported > 0 AND (asked = 0 OR proved > 0) AND sc > 0 AND sc >= 0.25 AS eligible FROM p LEFT JOIN s USING (pair_id))
SELECT pair_id, sc AS composite_score, supported, responsibility_coverage, applied_coverage, eligible, CASE WHEN NOT eligible THEN 'INSUFFICIENT_SUPPORTED_RELEVANCE' END AS reason FROM e""")
def coverage_scores(spark, d):
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    cover = F.col("l_quantity").cast("long") % 5 / 4
    sub = F.col("l_partkey") % 17 == 0
    a = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"), pick(list(coverage.WEIGHTS), "l_partkey").alias("category"), pick(("skill", "responsibility", "project"), "l_suppkey").alias("kind"),
        F.when(F.col("l_suppkey") % 5 == 0, "preference").otherwise("requirement").alias("treatment"), (1 + F.col("l_linenumber") % 3).alias("importance"), cover.alias("coverage"),
        F.when((cover == 1) & ~sub, "DIRECT").otherwise("PARTIAL").alias("status"), sub.alias("accepted_substitute"), (F.col("l_linenumber") % 4).alias("n_groups"),
    )
    return coverage.coverage_scores(a, 0.25)


BAD = ("", "SKILLS:0", "SKILLS:01", "skills:1", "SKILLS:1 ", "NONE", "SKILLS:999", "PROJECTS:1", "SKILLS:1", "SKILLS:2")


@plan(f"""WITH r AS (SELECT l_orderkey AS pair_id, category, category || ':' || row_number() OVER (PARTITION BY l_orderkey, category ORDER BY l_linenumber, l_tax > 0.01) AS citation, l_tax FROM
  (SELECT *, (['SKILLS', 'PROJECTS'])[l_linenumber % 2 + 1] AS category FROM lineitem)),
 c AS (SELECT o_orderkey AS pair_id, 'SKILLS' AS category, ([{', '.join(f"'{b}'" for b in BAD)}])[o_orderkey % {len(BAD)} + 1] AS citation FROM orders)
SELECT c.*, CASE WHEN NOT regexp_full_match(c.citation, '(SKILLS|EXPERIENCE|PROJECTS|EDUCATION):[1-9][0-9]*') THEN 'MALFORMED_CITATION' WHEN r.category IS NULL THEN 'UNKNOWN_CITATION'
 WHEN r.category <> c.category THEN 'WRONG_CATEGORY' END AS reason FROM c LEFT JOIN (SELECT * FROM r WHERE l_tax > 0.01) r ON c.pair_id = r.pair_id AND c.citation = r.citation""")
def citation_checks(spark, d):
    kind = F.when(F.col("l_linenumber") % 2 == 0, "SKILLS").otherwise("PROJECTS")
    text = F.when(F.col("l_tax") > 0.01, "evidence").otherwise(" ")
    known = evidence.registry(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), kind.alias("category"), F.col("l_linenumber").alias("ordinal"), text.alias("text")))
    cited = F.element_at(F.array(*map(F.lit, BAD)), (F.col("o_orderkey") % len(BAD) + 1).cast("int"))
    return evidence.check_citations(table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.lit("SKILLS").alias("category"), cited.alias("citation")), known)


@plan(f"""WITH {PAIRS}, o AS (SELECT job, pair_id, CASE WHEN pair_id % 13 <> 0 THEN score END AS score, pair_id % 6 = 0 AS doubt, pair_id % 8 = 3 AS severe FROM pairs),
 s AS (SELECT *, CASE WHEN score IS NULL THEN 'EVALUATION_FAILED' WHEN doubt OR severe THEN 'REVIEW_REQUIRED' ELSE 'SUCCESS' END AS status FROM o)
SELECT job, pair_id, status, CASE WHEN status <> 'SUCCESS' THEN NULL WHEN score >= 75 THEN 'STRONG_MATCH' WHEN score >= 55 THEN 'POTENTIAL_MATCH' ELSE 'LOW_MATCH' END AS tier,
 row_number() OVER (PARTITION BY job ORDER BY CASE status WHEN 'SUCCESS' THEN 1 WHEN 'REVIEW_REQUIRED' THEN 2 ELSE 3 END, coalesce(score, 0) DESC, pair_id) AS place FROM s""")
def evaluation_outcomes(spark, d):
    x = pairs(spark, d).select("job", "pair_id", F.when(F.col("pair_id") % 13 != 0, F.col("score")).alias("score"))
    severity = F.when(F.col("pair_id") % 8 == 3, "HIGH").otherwise("LOW")
    x = x.withColumn("o", evidence.outcome(F.col("score"), (F.col("pair_id") % 6 == 0).cast("int"), severity)).select("job", "pair_id", "score", "o.*")
    return lifecycle.ranks(x, "job", evidence.result_order()).drop("score")


@plan("SELECT doc_id, CAST(ceil(strlen(coalesce(text, '')) / 3) + 128 AS BIGINT) AS tokens, ceil(strlen(coalesce(text, '')) / 3) + 128 <= 1000 AS fits FROM documents")
def token_budget(spark, d):
    return table(spark, d, "documents").select("doc_id", evidence.token_budget(F.col("text"), 1000).alias("b")).select("doc_id", "b.*")


@plan(f"""WITH {PAIRS} SELECT pair_id, CASE WHEN c_custkey IS NOT NULL AND status NOT IN ({ONE_OF}) THEN 'EXTRACTION_FAILED' ELSE status END AS status,
 CASE WHEN c_custkey IS NOT NULL AND status NOT IN ({ONE_OF}) THEN 'EMPTY_' || c_mktsegment END AS failure_code FROM pairs LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 = 0) c ON doc_id = c_custkey""")
def extraction_failures(spark, d):
    failed = table(spark, d, "customer").where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("EMPTY_"), "c_mktsegment").alias("error_code"))
    return lifecycle.extraction_failures(pairs(spark, d).select("pair_id", "doc_id", "status"), failed).drop("doc_id")


@plan(f"""WITH {PAIRS}, n AS (SELECT *, CASE WHEN pair_id % 3 = 0 THEN 'SUCCESS' WHEN pair_id % 3 = 1 THEN status ELSE 'CUTOFF_EXCLUDED' END AS new, pair_id % 5 <> 0 AS same, CASE WHEN pair_id % 4 <> 0 THEN score END AS s FROM pairs)
SELECT pair_id, CASE WHEN new NOT IN ({ONE_OF}) THEN 'REJECTED' WHEN status IN ({ONE_OF}) THEN CASE WHEN status = new AND same THEN 'NO_OP' ELSE 'CONFLICT' END WHEN new = 'SUCCESS' AND s IS NULL THEN 'REJECTED' ELSE 'WRITTEN' END AS action FROM n""")
def terminal_writes(spark, d):
    k = F.col("pair_id")
    new = F.when(k % 3 == 0, "SUCCESS").when(k % 3 == 1, F.col("status")).otherwise("CUTOFF_EXCLUDED")
    return pairs(spark, d).select("pair_id", lifecycle.terminal_write(F.col("status"), new, k % 5 != 0, F.when(k % 4 != 0, F.col("score"))).alias("action"))


@plan("""WITH s AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey)
SELECT o_orderkey AS request, CASE WHEN k IS NULL THEN 'NEW' WHEN k % 10 <> o_orderkey % 10 THEN 'CONFLICT' WHEN k % 2 = 0 THEN 'REPLAY' ELSE 'IN_PROGRESS' END AS action FROM orders o LEFT JOIN s USING (o_custkey)""")
def request_replays(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("owner"), F.md5((F.col("o_orderkey") % 10).cast("string").cast("binary")).alias("request_hash"))
    stored = o.where("request % 3 = 0").groupBy("owner").agg(F.max("request").alias("k"))
    stored = stored.select("owner", F.md5((F.col("k") % 10).cast("string").cast("binary")).alias("request_hash"), (F.col("k") % 2 == 0).alias("finished"))
    return lifecycle.replays(o, stored, ["owner"]).select("request", "action")


@plan("""SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-15' THEN CASE WHEN user_id % 4 >= 3 THEN 'PROCESSING_FAILED' ELSE 'PENDING' END WHEN event_type = 'click' THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
 CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-15' AND user_id % 4 >= 3 THEN 'RETRIEVAL_ATTEMPTS_EXHAUSTED' END AS failure_code FROM events""")
def stale_work(spark, d):
    status = F.when(F.col("event_type") == "click", "RUNNING").otherwise("SUCCESS")
    now = F.expr("timestamp_ntz '2024-01-15'")
    return table(spark, d, "events").select("event_id", lifecycle.stale(status, F.col("ts"), now, F.col("user_id") % 4, 3).alias("s")).select("event_id", "s.*")


@plan("""WITH e AS (SELECT o_custkey AS pair_id, o_orderkey AS seq, (['SHORTLIST', 'HOLD', 'NOT_PROCEEDING'])[o_orderkey % 3 + 1] AS decision, CASE WHEN o_orderkey % 2 = 0 THEN 'because' END AS reason,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS notes FROM orders), k AS (SELECT * FROM e WHERE decision <> 'NOT_PROCEEDING' OR reason IS NOT NULL)
SELECT pair_id, count(*) AS version, arg_max(decision, seq) AS decision, arg_max(coalesce(reason, ''), seq) AS reason, coalesce(arg_max(notes, seq) FILTER (notes IS NOT NULL), '') AS notes FROM k GROUP BY pair_id""")
def review_fold(spark, d):
    k = F.col("o_orderkey")
    decision = F.element_at(F.array(*map(F.lit, ("SHORTLIST", "HOLD", "NOT_PROCEEDING"))), (k % 3 + 1).cast("int"))
    e = table(spark, d, "orders").select(
        F.col("o_custkey").alias("pair_id"), k.alias("seq"), decision.alias("decision"), F.when(k % 2 == 0, "because").alias("reason"), F.when(k % 5 == 0, F.col("o_orderpriority")).alias("notes"),
        F.lit(None).cast("array<string>").alias("tags"),
    )
    return lifecycle.reviews(e).drop("tags")


@plan(f"""WITH {PAIRS} SELECT job, pair_id, place FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY s DESC NULLS LAST, pair_id) AS place FROM
 (SELECT *, CASE WHEN pair_id % 6 <> 0 THEN score END AS s FROM pairs WHERE status IN ('SUCCESS', 'REVIEW_REQUIRED') AND (CASE WHEN pair_id % 6 <> 0 THEN score END BETWEEN 20 AND 90 OR applied >= 2)))""")
def pool_view(spark, d):
    x = pairs(spark, d).withColumn("s", F.when(F.col("pair_id") % 6 != 0, F.col("score")))
    x = x.where(F.col("status").isin("SUCCESS", "REVIEW_REQUIRED") & (F.col("s").between(20, 90) | (F.col("applied") >= 2)))
    return lifecycle.ranks(x, "job", lifecycle.pool_order("s", True)).select("job", "pair_id", "place")


@plan(f"""WITH {PAIRS} SELECT job, count(*) AS pairs, count(*) FILTER (status IN ({ONE_OF})) AS terminal, count(*) FILTER (status = 'SHORTLISTED') AS selected,
 count(*) = (SELECT count(*) FROM orders o WHERE o.o_orderpriority = job) AND count(*) FILTER (status = 'SHORTLISTED') <= 15 AS reconciled FROM pairs GROUP BY job""")
def accounting(spark, d):
    want = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("job")).agg(F.count("*").alias("expected"))
    return measures.reconcile(pairs(spark, d), want, F.col("status") == "SHORTLISTED", F.col("status").isin(*TERMINAL), 15)


@plan("""SELECT event_type AS provider, CASE WHEN count(*) FILTER (event_id % 4 <> 0) = 0 THEN NULL WHEN event_type = 'click' THEN round(sum(k * 0.15::DOUBLE + user_id * 0.60::DOUBLE) / 1000000, 6)
 WHEN event_type = 'view' THEN round(sum(k * 0.75::DOUBLE + user_id * 3.75::DOUBLE) / 1000000, 6) END AS estimate FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""")
def cost_estimate(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_type").alias("provider"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), F.col("user_id").alias("output_tokens"), (F.col("event_id") % 4 != 0).alias("with_usage")
    )
    return measures.cost_estimates(e, ["provider"], {("click",): (0.15, 0.60), ("view",): (0.75, 3.75)})


@plan(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, pair_id) AS n FROM pairs), c AS (SELECT job, score AS cut FROM r WHERE n = 15)
SELECT job, count(*) FILTER (score = cut) AS tie_size, count(*) FILTER (score > cut) AS above, count(*) FILTER (n <= 15 AND pair_id % 3 = 0) / 15 AS precision FROM r JOIN c USING (job) GROUP BY job""")
def cutoff_ties(spark, d):
    return measures.cutoff_ties(pairs(spark, d), F.col("pair_id") % 3 == 0, 15)


@plan("""SELECT quality AS expected, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE 1 END AS actual, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def confusion_counts(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return x.groupBy(F.col("quality").alias("expected"), F.when(F.col("n_chars") % 3 == 0, 0).otherwise(1).alias("actual")).agg(F.count("*").alias("n"))


@plan(r"""SELECT doc_id, round(100 * (1 - strlen(regexp_replace(text, '\s+', ' ', 'g')) / strlen(text)), 2) AS reduction FROM documents WHERE strlen(text) > 0""")
def size_reduction(spark, d):
    short = F.octet_length(F.regexp_replace("text", r"\s+", " "))
    return table(spark, d, "documents").where("octet_length(text) > 0").select("doc_id", F.round((1 - short / F.octet_length("text")) * 100, 2).alias("reduction"))


LIMITS = ("Limit: tokens per day. Requested 1200", "tokens per minute; requested: 77", "slow down", "tokens_per_day", "")


@plan(f"""SELECT event_id, CASE WHEN contains(replace(lower(m), '_', ' '), 'tokens per day') THEN 'PROVIDER_DAILY_TOKEN_LIMIT' WHEN contains(lower(m), 'tokens per minute') THEN 'PROVIDER_MINUTE_TOKEN_LIMIT' ELSE 'PROVIDER_RATE_LIMITED' END AS error_code,
 CAST(nullif(regexp_extract(lower(m), 'requested\\s*[:=]?\\s*(\\d+)', 1), '') AS BIGINT) AS requested FROM (SELECT event_id, ([{', '.join(f"'{m}'" for m in LIMITS)}])[event_id % {len(LIMITS)} + 1] AS m FROM events)""".replace("\\\\", "\\"))
def provider_limits(spark, d):
    said = F.element_at(F.array(*map(F.lit, LIMITS)), (F.col("event_id") % len(LIMITS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", measures.limit_error(said).alias("e")).select("event_id", "e.*")


@plan(r"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark), t AS (SELECT * FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]{2,}')),
 d AS (SELECT doc_id, round(count(v.w) / count(*), 2) AS density FROM t LEFT JOIN v USING (w) GROUP BY doc_id) SELECT doc_id, coalesce(density, 0) AS density FROM documents LEFT JOIN d USING (doc_id)""")
def dictionary_density(spark, d):
    return measures.dictionary_density(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("text"))


@plan("SELECT event_type AS counter, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS delta, max(value) AS peak FROM events GROUP BY event_type")
def counter_deltas(spark, d):
    return measures.counter_deltas(table(spark, d, "events").withColumnRenamed("event_type", "counter"), "counter", "event_id", "value")


@plan(f"""WITH {PAIRS}, r AS (SELECT job, CASE WHEN job LIKE '1%' AND rank = 7 THEN 0 ELSE pair_id END AS pair_id, CASE WHEN job LIKE '2%' AND rank > 50 THEN rank + 1 ELSE rank END AS rank, CASE WHEN job LIKE '3%' AND rank = 9 THEN 0 ELSE score END AS score
 FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, pair_id) AS rank FROM pairs)), l AS (SELECT *, lag(score) OVER (PARTITION BY job ORDER BY rank) AS before FROM r)
SELECT job, count(DISTINCT pair_id) = count(*) AS "unique", max(rank) = count(*) AND min(rank) = 1 AS contiguous, count(*) FILTER (score > before) = 0 AS sorted FROM l GROUP BY job""")
def ranking_checks(spark, d):
    x = lifecycle.ranks(pairs(spark, d), "job", [F.desc("score"), F.col("pair_id")])
    r, job = F.col("place"), F.col("job")
    x = x.select(
        "job", F.when(job.startswith("1") & (r == 7), 0).otherwise(F.col("pair_id")).alias("pair_id"), F.when(job.startswith("2") & (r > 50), r + 1).otherwise(r).alias("rank"),
        F.when(job.startswith("3") & (r == 9), 0.0).otherwise(F.col("score")).alias("score"),
    )
    return measures.ranking_checks(x, "job", "pair_id")


@plan(f"WITH {PAIRS} SELECT doc_id, job, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) > 1")
def duplicate_probe(spark, d):
    return measures.repeated_keys(pairs(spark, d), ["doc_id", "job"])
