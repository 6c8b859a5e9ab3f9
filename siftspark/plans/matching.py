"""Queries on skills, targets, claims, degrees, constraints and page texts, with the same questions in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.functions.text import MAIL
from siftspark.operators import checks, history, pages, rules, sections, skills

from .catalogue import plan
from .relations import PROFILES, profiles, table
from .screening import SECTIONS

NOT = r"regexp_replace(text, '(?i)\b(no|not|without|lack|lacking|never)\b[^.!?\n]*', '', 'g')"
JAVA, BOOT, K8S, NET = ("Java", (), ("Kotlin",)), ("Spring Boot", (), ()), ("Kubernetes", ("K8s",), ("Docker",)), (".NET", (), ("Java",))
SPARK, SQL, PYTHON = ("Apache Spark", (), ()), ("SQL", (), ("PostgreSQL",)), ("Python", (), ())
JOBS = {"backend": [JAVA, BOOT], "cloud": [K8S, NET], "data": [SPARK, SQL, PYTHON], "open": []}
WANTED = rf"""{PROFILES}, wanted AS (SELECT * FROM (VALUES ('backend', 'Java', 'java', 'kotlin'), ('backend', 'Spring Boot', 'spring[\s._-]*boot', '#'), ('cloud', 'Kubernetes', 'kubernetes|k8s', 'docker'),
  ('cloud', '.NET', '\.net|dotnet|dot[\s._-]*net', 'java'), ('data', 'Apache Spark', 'spark|apache[\s._-]*spark', '#'), ('data', 'SQL', 'sql', 'postgresql|postgres'), ('data', 'Python', 'python', '#')) AS w(job, skill, p, q)),
 found AS (SELECT doc_id, job, skill, CASE WHEN regexp_matches(a, '(?i)(^|\W)(' || p || ')(\W|$)') THEN 1.0::DOUBLE WHEN regexp_matches(a, '(?i)(^|\W)(' || q || ')(\W|$)') THEN 0.75::DOUBLE ELSE 0 END AS weight,
  regexp_matches(text, '(?i)(^|\W)(' || p || '|' || q || ')(\W|$)') AS said FROM (SELECT *, {NOT} AS a FROM profiles), wanted)"""


@plan("""WITH g AS (SELECT * FROM (VALUES (['JavaScript', 'Java Script', 'JS']), (['C#', 'C Sharp', 'CSharp']), (['ETL', 'extract-transform-load', 'extract transform load'])) AS t(names)),
 t AS (SELECT p_partkey AS id, (['js', 'Go', 'CSHARP', 'etl', 'Rust'])[p_partkey % 5 + 1] AS a, (['Go', 'C sharp', 'SQL'])[p_partkey % 3 + 1] AS b, CASE WHEN a = b THEN [a] ELSE [a, b] END AS terms FROM part)
SELECT id, array_to_string(terms, '|') || coalesce((SELECT string_agg('|' || array_to_string(names, '|'), '' ORDER BY CASE names[1] WHEN 'JavaScript' THEN 1 WHEN 'C#' THEN 2 ELSE 3 END)
 FROM g WHERE list_has_any(list_transform(names, lambda x: lower(x)), list_transform(terms, lambda x: lower(x)))), '') AS terms FROM t""")
def identity_terms(spark, d):
    one = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    terms = F.array(one(("js", "Go", "CSHARP", "etl", "Rust")), one(("Go", "C sharp", "SQL")))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), skills.expanded(terms).alias("terms"))
    return x.select("id", F.array_join("terms", "|").alias("terms"))


@plan(rf"""WITH {WANTED} SELECT doc_id, skill, max(weight) AS weight, CASE WHEN max(weight) > 0 THEN 'REQUIRED_SKILL_FOUND' WHEN bool_or(said) THEN 'REQUIRED_SKILL_NEGATED' ELSE 'REQUIRED_SKILL_NOT_DOCUMENTED' END AS code
FROM found GROUP BY ALL""")
def skill_checks(spark, d):
    some = [s for skills_ in JOBS.values() for s in skills_]
    found = F.array(*[F.struct(F.lit(s[0]).alias("skill"), skills.evidence(F.col("text"), *s).alias("e")) for s in some])
    x = profiles(spark, d).select("doc_id", F.explode(found).alias("f"))
    return x.select("doc_id", "f.skill", "f.e.weight", skills.skill_check(F.col("f.e")).alias("code"))


@plan(f"WITH {WANTED} SELECT doc_id, job, round(sum(weight) / count(*), 2) AS score FROM found GROUP BY doc_id, job HAVING sum(weight) / count(*) >= 0.5")
def profile_matches(spark, d):
    return skills.profile_matches(profiles(spark, d), JOBS).drop("skills")


TARGETS = [
    {"target_id": "apis", "category": "EXPERIENCE", "kind": "responsibility", "groups": [["payment API", "payment APIs"], ["Java"]]},
    {"target_id": "cluster", "category": "SKILLS", "kind": "skill", "groups": [["Kubernetes"]]},
    {"target_id": "reports", "category": "PROJECTS", "kind": "project", "groups": [["reporting system"]], "substitutes": ["Spring Boot microservices"]},
    {"target_id": "degree", "category": "EDUCATION", "kind": "education", "groups": [["Bachelor"], ["Computer Science", "Information Technology"]]},
]
_IS = lambda p: rf"regexp_matches(passage, '(?i)(^|\W)({p})(\W|$)')::INT"
_WORK = r"section IN ('EXPERIENCE', 'PROJECTS') AND regexp_matches(passage, '(?i)\b(built|developed|deployed|automated|maintained|tested|designed|implemented)\b')"


@plan(rf"""WITH {SECTIONS}, u AS (SELECT doc_id, CASE section WHEN 'SUMMARY' THEN 'EXPERIENCE' WHEN 'CERTIFICATIONS' THEN 'EDUCATION' ELSE section END AS section, section AS chunk,
  string_split(regexp_replace(regexp_replace(content, '([.!?])[ \t\r\f\v]+\s*([A-Z])', '\1' || chr(10) || '\2', 'g'), ';', chr(10), 'g'), chr(10)) AS p FROM sections),
 v AS (SELECT doc_id, section, chunk, trim(unnest(p), chr(9) || ' ') AS passage, generate_subscripts(p, 1) AS i FROM u),
 c AS (SELECT *, NOT regexp_matches(passage, '(?i)\b(no|not|without|lack|lacking|never)\b') AS fine FROM v WHERE passage <> ''),
 t AS (SELECT doc_id, chunk, i, passage, 'apis' AS target_id, false AS sub, CASE WHEN fine AND {_WORK} THEN ({_IS('payment[ ]*apis?')} + {_IS('java')}) / 2 ELSE 0 END AS cover FROM c
  UNION ALL SELECT doc_id, chunk, i, passage, 'cluster', false, CASE WHEN fine AND section <> 'EDUCATION' THEN {_IS('kubernetes|k8s')} ELSE 0 END FROM c
  UNION ALL SELECT doc_id, chunk, i, passage, 'reports', fine AND {_WORK} AND {_IS('spring boot microservices')} = 1, CASE WHEN fine AND {_WORK} THEN greatest({_IS('reporting system')}, 0.5::DOUBLE * {_IS('spring boot microservices')}) ELSE 0 END FROM c
  UNION ALL SELECT doc_id, chunk, i, passage, 'degree', false, CASE WHEN fine AND section = 'EDUCATION' THEN ({_IS('bachelor')} + {_IS('computer science|information technology')}) / 2 ELSE 0 END FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target_id ORDER BY cover DESC, chunk, i) AS n FROM t)
SELECT doc_id, target_id, cover AS coverage, sub AS accepted_substitute, CASE WHEN cover = 0 THEN 'MISSING_INFORMATION' WHEN cover = 1 THEN 'DIRECT' ELSE 'PARTIAL' END AS status, CASE WHEN cover > 0 THEN passage END AS passage FROM r WHERE n = 1""")
def target_assessments(spark, d):
    parsed = sections.sections(profiles(spark, d))
    category = F.element_at(F.create_map(*[F.lit(v) for kv in sections.CATEGORY.items() for v in kv]), F.col("section"))
    x = sections.passages(parsed.select(F.struct("doc_id", "section", category.alias("category")).alias("doc_id"), F.col("content").alias("text")))
    x = x.select("doc_id.doc_id", "doc_id.category", F.col("doc_id.section").alias("chunk_no"), "passage_no", "passage")
    return skills.assessments(x, TARGETS)


SAID = (
    "Total experience: 5 years", "Engineer with over 5 years of professional experience", "7+ years of work experience", "3 years of total experience in Java", "4 years of\nindustry experience.\n\nOverall experience: 4 yrs",
    "Total experience: 3 years\n\n6 years of professional experience", "Writes reports", "Overall work experience - 7.5 years", "5-7 years of work experience",
)
_P1, _P2 = history.CLAIMS


@plan(rf"""WITH s AS (SELECT c_custkey AS doc_id, ([{', '.join(f"'{x}'" for x in SAID)}])[c_custkey % {len(SAID)} + 1] AS text FROM customer),
 p AS (SELECT doc_id, trim(regexp_replace(unnest(string_split_regex(text, '\n\s*\n')), '\s+', ' ', 'g')) AS p FROM s),
 m AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(p, '(?i)(?:{history.BOUND})?{_P1}(?:{history.OF_ONE})?'), regexp_extract_all(p, '(?i)(?:{history.BOUND})?{_P2}(?:{history.OF_ONE})?'))) AS m FROM p),
 y AS (SELECT doc_id, CASE WHEN NOT (contains(m, '+') OR regexp_matches(m, '(?i)^{history.BOUND}({_P1}|{_P2})') OR regexp_matches(m, '(?i){history.OF_ONE}$'))
   THEN CAST(coalesce(nullif(regexp_extract(m, '(?i){_P1}', 1), ''), regexp_extract(m, '(?i){_P2}', 1)) AS DOUBLE) END AS y FROM m)
SELECT doc_id, doc_id IN (SELECT doc_id FROM m) AS claimed, CASE WHEN count(DISTINCT y) = 1 THEN min(y) END AS years FROM s LEFT JOIN y USING (doc_id) GROUP BY doc_id""")
def experience_claims(spark, d):
    text = F.element_at(F.array(*map(F.lit, SAID)), (F.col("c_custkey") % len(SAID) + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), history.claimed_years(text).alias("c")).select("doc_id", "c.*")


ZONE = rf"{PROFILES}, zones AS (SELECT doc_id, regexp_extract(text, '(?s)\nEDUCATION\n(.*)$', 1) AS zone FROM profiles)"


@plan(rf"""WITH {ZONE}, m AS (SELECT doc_id, zone, unnest(regexp_extract_all(upper(replace(zone, 'High School Diploma', 'High School')), '\b(BACHELOR|MASTER|MBA|HIGH SCHOOL)\b')) AS degree FROM zones)
SELECT doc_id, degree, CASE degree WHEN 'BACHELOR' THEN 4 WHEN 'HIGH SCHOOL' THEN 1 ELSE 5 END AS rank, contains(zone, 'Expected') AS in_progress, false AS ambiguous, true AS scoped, zone AS context FROM m""")
def degree_entries(spark, d):
    x = profiles(spark, d)
    return history.degree_entries(x, sections.sections(x)).drop("line")


@plan(f"""WITH {ZONE}, j AS (SELECT unnest(['dev', 'lead', 'any']) AS job) SELECT doc_id, job, CASE WHEN job = 'any' THEN 'EDUCATION_NOT_REQUIRED' WHEN zone = '' THEN 'EDUCATION_UNKNOWN'
 WHEN job = 'lead' THEN CASE WHEN zone LIKE 'Master%' THEN 'EDUCATION_MET' ELSE 'EDUCATION_LEVEL_MISMATCH' END WHEN zone LIKE 'High School%' THEN 'EDUCATION_LEVEL_MISMATCH'
 WHEN zone LIKE '%Information Technology%Expected%' THEN 'EDUCATION_IN_PROGRESS' WHEN zone LIKE '%Computer Science%' THEN 'EDUCATION_MET' ELSE 'EDUCATION_FIELD_MISMATCH' END AS code FROM zones, j""")
def education_checks(spark, d):
    x = profiles(spark, d)
    asked = {"dev": (rules.DEGREES["BACHELOR"], ["computer science", "information technology"]), "lead": (rules.DEGREES["MASTER"], []), "any": (0, [])}
    return history.education_checks(x, history.degree_entries(x, sections.sections(x)), asked)


@plan("""SELECT l_orderkey AS job, l_returnflag AS key, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS value, count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY ALL""")
def rule_conflicts(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("value"))
    return checks.merged_rules(x, ["job", "key"], "value")


@plan("""SELECT c_custkey AS doc_id, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'NEGATIVE_YEARS' END, CASE WHEN c_custkey % 6 IN (0, 3) AND c_custkey % 4 IN (1, 3) AND (c_custkey % 6 = 0) <> (c_custkey % 4 = 1) AND c_custkey % 5 <> 0 THEN 'CONTRADICTORY_AUTHORIZATION' END,
 CASE WHEN trim(c_mktsegment) = '' OR length(c_mktsegment) > 9 THEN 'BAD_TERM' END], lambda x: x IS NOT NULL)) AS code FROM customer""")
def contract_violations(spark, d):
    k = F.col("c_custkey")
    state = lambda yes, no: F.when(yes, "eligible").when(no, "ineligible")
    clash = checks.contradicts(state(k % 6 == 0, k % 6 == 3), state(k % 4 == 1, k % 4 == 3), F.when(k % 5 == 0, "eligible"))
    broken = {"NEGATIVE_YEARS": F.col("c_acctbal") < 0, "CONTRADICTORY_AUTHORIZATION": clash, "BAD_TERM": (F.trim("c_mktsegment") == "") | (F.length("c_mktsegment") > 9)}
    return checks.violations(table(spark, d, "customer").withColumn("doc_id", k), ["doc_id"], broken)


BLOCKS = """b AS (SELECT l_orderkey AS doc_id, 1 AS page_number, l_linenumber AS block_no, CASE WHEN l_linenumber % 6 = 0 THEN 1 ELSE 0 END AS block_type, l_partkey % 3 * 150 AS x0, l_suppkey % 5 * 40 AS y0,
 l_partkey % 3 * 150 + CASE WHEN l_suppkey % 4 = 0 THEN 420 ELSE 140 END AS x1, CASE WHEN l_partkey % 11 = 0 THEN ' ' ELSE 'block' END AS text FROM lineitem)"""


@plan(f"""WITH {BLOCKS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, block_no) AS o, (min(x0) OVER (PARTITION BY doc_id) + max(x1) OVER (PARTITION BY doc_id)) / 2 AS mid FROM b WHERE block_type = 0 AND trim(text) <> ''),
 s AS (SELECT *, CASE WHEN x0 < mid - 40 AND x1 > mid + 40 THEN 2 WHEN x1 <= mid + 40 THEN 0 ELSE 1 END AS side FROM k),
 r AS (SELECT s.*, (SELECT count(*) FROM s w WHERE w.doc_id = s.doc_id AND w.side = 2 AND CASE WHEN s.side = 2 THEN w.o < s.o ELSE w.y0 <= s.y0 END) AS run FROM s)
SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id ORDER BY run, side, y0, CASE WHEN side = 2 THEN x0 END, block_no) AS place FROM r""")
def reading_order(spark, d):
    x = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as doc_id", "1 as page_number", "l_linenumber as block_no", "case when l_linenumber % 6 = 0 then 1 else 0 end as block_type", "l_partkey % 3 * 150 as x0", "l_suppkey % 5 * 40 as y0",
        "l_partkey % 3 * 150 + case when l_suppkey % 4 = 0 then 420 else 140 end as x1", "case when l_partkey % 11 = 0 then ' ' else 'block' end as text",
    )
    return pages.reading_order(x).select("doc_id", "block_no", "place")


@plan("""SELECT doc_id, length(t) AS chars, md5(regexp_replace(t, '[^\\t\\n\\r\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]', ' ', 'g')) AS digest FROM (SELECT doc_id, text || chr((doc_id % 31 + 1)::INT) || 'x' AS t FROM documents)""")
def xml_safe(spark, d):
    t = F.concat("text", F.char(F.col("doc_id") % 31 + 1), F.lit("x"))
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("chars"), F.md5(pages.xml_safe(t).cast("binary")).alias("digest"))


@plan(rf"SELECT doc_id, md5(regexp_replace(text, '(?m)^.*{MAIL}.*$', '[REDACTED_CONTACT]', 'g')) AS digest FROM documents")
def contact_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(pages.mask_lines(F.col("text"), [MAIL]).cast("binary")).alias("digest"))


@plan(rf"""WITH {PROFILES}, h AS (SELECT doc_id, text, regexp_extract(text, '(?is)^(.*?)\n(?:technical\s+skills|skills|experience|work\s+history|education|summary)\b', 1) AS header FROM profiles)
SELECT doc_id, header, length(text) - length(header) AS body FROM h""")
def header_split(spark, d):
    x = profiles(spark, d).select("doc_id", pages.header_and_body(F.col("text")).alias("h"))
    return x.select("doc_id", "h.header", F.length("h.body").alias("body"))


@plan(rf"""WITH {PROFILES}, m AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN text ELSE regexp_replace(text, '{MAIL}', '[REDACTED_EMAIL]', 'g') END AS text FROM profiles)
SELECT count(*) AS texts, count(*) FILTER (regexp_matches(text, '{MAIL}')) AS mail_pattern, count(*) FILTER (contains(lower(text), 'person ' || doc_id)) AS known_name, count(*) FILTER (contains(text, 'user' || doc_id || '@example.com')) AS known_mail FROM m""")
def privacy_audit(spark, d):
    x = profiles(spark, d).withColumn("text", F.when(F.col("doc_id") % 10 == 4, F.col("text")).otherwise(F.regexp_replace("text", MAIL, "[REDACTED_EMAIL]")))
    who = table(spark, d, "customer").selectExpr("c_custkey as doc_id", "concat('Person ', c_custkey) as name", "concat('user', c_custkey, '@example.com') as mail")
    return pages.leaks(x, who, MAIL)


@plan(r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([!?])(\s)', '\1' || chr(1) || '\2', 'g'), '\.(\s+[A-Z])', '.' || chr(1) || '\1', 'g'), chr(1)) AS p FROM documents),
 u AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM p), o AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) - length(s) AS start FROM u)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal, CAST(start AS BIGINT) AS start, length(s) AS chars FROM o WHERE regexp_matches(s, '\S')""")
def sentence_registry(spark, d):
    return pages.sentences(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ordinal", "start", F.length("sentence").alias("chars"))
