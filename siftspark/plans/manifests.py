"""Queries on manifests, prompt budgets and verdicts, with the same questions in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators import manifests

from .catalogue import plan
from .relations import PAIRS, pairs, table

KINDS = ("SKILLS", "EXPERIENCE", "PROJECTS", "EDUCATION")
SENT = "l_orderkey AS pair_id, (['SKILLS', 'EXPERIENCE', 'PROJECTS', 'EDUCATION'])[l_suppkey % 4 + 1] AS category, l_linenumber AS ordinal, 'text ' || l_partkey AS text"


@plan(f"""WITH s AS (SELECT {SENT} FROM lineitem), h AS (SELECT *, CASE category WHEN 'EDUCATION' THEN 'D' ELSE category[1] END || row_number() OVER (PARTITION BY pair_id, category ORDER BY ordinal, text) AS handle FROM s),
 c AS (SELECT pair_id, sha256(array_to_string(list_sort(list(sha256(concat_ws(chr(31), handle, text)))), '')) AS scope FROM h GROUP BY pair_id)
SELECT pair_id, handle, text, scope FROM h JOIN c USING (pair_id)""")
def manifest_handles(spark, d):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), kind.alias("category"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("text "), "l_partkey").alias("text"))
    return manifests.with_handles(x).select("pair_id", "handle", "text", "scope")


@plan("""WITH g AS (SELECT l_orderkey AS pair_id, l_partkey * 10 + l_linenumber AS priority, CAST(l_quantity * 20 AS BIGINT) AS bytes FROM lineitem),
 u AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY pair_id ORDER BY priority, bytes ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM g)
SELECT pair_id, priority, used, CAST(ceil(used / 3) + 128 AS BIGINT) AS tokens FROM u WHERE used <= 1500 AND ceil(used / 3) + 128 <= 600""")
def prompt_budget(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("priority"), (F.col("l_quantity") * 20).cast("long").alias("bytes"))
    return manifests.within_budget(x, 1500, 600).select("pair_id", "priority", "used", "tokens")


@plan(f"""WITH {PAIRS}, k AS (SELECT pair_id, 'SKILLS' AS category, 'SKILLS:1' AS citation FROM pairs WHERE pair_id % 3 <> 0 UNION ALL SELECT pair_id, 'EDUCATION', 'EDUCATION:1' FROM pairs),
 c AS (SELECT pair_id, 'SKILLS' AS category, (['SKILLS:1', 'EDUCATION:1', 'none'])[pair_id % 5 % 3 + 1] AS citation FROM pairs),
 v AS (SELECT c.*, NOT regexp_full_match(c.citation, '(SKILLS|EXPERIENCE|PROJECTS|EDUCATION):[1-9][0-9]*') OR k.category IS NULL OR k.category <> c.category AS bad FROM c LEFT JOIN k ON k.pair_id = c.pair_id AND k.citation = c.citation),
 r AS (SELECT pair_id, 'MISSING_EVIDENCE:' || x AS reason FROM pairs, (VALUES ('experience'), ('projects')) t(x) UNION ALL SELECT pair_id, 'MISSING_EVIDENCE:skills' FROM pairs WHERE pair_id % 3 = 0 UNION ALL SELECT pair_id, 'INVALID_CITATIONS:skills' FROM v WHERE bad
  UNION ALL SELECT pair_id, 'UNVERIFIED_FLAG:skills' FROM v WHERE bad AND pair_id % 4 = 0 UNION ALL SELECT pair_id, 'INJECTION_SIGNALS' FROM pairs WHERE pair_id % 7 = 0 UNION ALL SELECT pair_id, 'CONTEXT_TRUNCATED' FROM pairs WHERE pair_id % 11 = 0)
SELECT pair_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, (SELECT CASE WHEN NOT any_value(bad) THEN any_value(citation) ELSE '' END FROM v WHERE v.pair_id = r.pair_id) AS valid, (SELECT CASE WHEN any_value(bad) THEN any_value(citation) ELSE '' END FROM v WHERE v.pair_id = r.pair_id) AS invalid FROM r GROUP BY pair_id""")
def verdict_reasons(spark, d):
    p, k = pairs(spark, d), F.col("pair_id")
    row = lambda c, n: (F.lit(c).alias("category"), n.alias("citation"))
    known = p.where("pair_id % 3 <> 0").select("pair_id", *row("SKILLS", F.lit("SKILLS:1"))).union(p.select("pair_id", *row("EDUCATION", F.lit("EDUCATION:1"))))
    cited = p.select("pair_id", *row("SKILLS", F.element_at(F.array(F.lit("SKILLS:1"), F.lit("EDUCATION:1"), F.lit("none")), (k % 5 % 3 + 1).cast("int"))))
    flags = p.select("pair_id", F.lit("SKILLS").alias("category"), F.when(k % 4 == 0, "HIGH").otherwise("LOW").alias("severity"))
    return manifests.verdicts(p.select("pair_id", (k % 7 == 0).alias("injected"), (k % 11 == 0).alias("truncated")), cited, known, flags)


@plan("""WITH f AS (SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 13 <> 0), m AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN quality = 0 THEN 'x' ELSE '' END) AS expected FROM documents JOIN labels USING (doc_id))
SELECT CAST(coalesce(f.doc_id, m.doc_id) AS VARCHAR) AS name, CASE WHEN expected IS NULL THEN 'NOT_LISTED' WHEN hash IS NULL THEN 'MISSING' WHEN hash <> expected THEN 'MISMATCH' ELSE 'ACCEPTED' END AS code FROM f FULL JOIN m ON f.doc_id = m.doc_id""")
def manifest_check(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("name"), "quality")
    listed = docs.join(labels, "name").select("name", F.sha2(F.concat("text", F.when(F.col("quality") == 0, "x").otherwise(F.lit(""))), 256).alias("hash"))
    return manifests.against_manifest(docs.where("name % 13 <> 0").select("name", F.sha2("text", 256).alias("hash")), listed)


@plan("""WITH RECURSIVE p AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS pair_id, l_linenumber AS idx, l_linenumber // 3 AS section, (['CONTEXT', 'EXPERIENCE', 'PROJECTS', 'SKILLS', 'EDUCATION'])[l_linenumber % 5 + 1] AS category,
  repeat('x', (l_linenumber * 37 + l_orderkey) % 90 + 10) || CASE WHEN (l_orderkey + l_linenumber) % 6 = 0 THEN ' Kafka' ELSE '' END AS text FROM lineitem),
 h AS (SELECT * FROM p WHERE (pair_id + idx) % 5 = 0), k AS (SELECT p.*, contains(lower(text), 'kafka') AS must, EXISTS (SELECT 1 FROM h WHERE h.pair_id = p.pair_id AND h.section = p.section AND abs(h.idx - p.idx) <= 1) AS near,
  row_number() OVER (PARTITION BY pair_id, category ORDER BY idx) AS turn, list_position(['CONTEXT', 'EXPERIENCE', 'PROJECTS', 'SKILLS', 'EDUCATION'], category) AS c FROM p),
 o AS (SELECT pair_id, idx, length(text) AS size, row_number() OVER (PARTITION BY pair_id ORDER BY NOT must, NOT near, CASE WHEN near THEN idx ELSE turn END, CASE WHEN near THEN 0 ELSE c END, idx) AS place FROM k),
 f AS (SELECT pair_id, idx, place, size <= 150 AS included, CASE WHEN size <= 150 THEN size ELSE 0 END AS used FROM o WHERE place = 1
  UNION ALL SELECT o.pair_id, o.idx, o.place, f.used + o.size <= 150, f.used + CASE WHEN f.used + o.size <= 150 THEN o.size ELSE 0 END FROM f JOIN o ON o.pair_id = f.pair_id AND o.place = f.place + 1)
SELECT pair_id, idx, place, included FROM f""")
def context_order(spark, d):
    k, n = F.col("pair_id"), F.col("idx")
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("idx")).distinct()
    text = F.concat(F.repeat(F.lit("x"), ((n * 37 + k) % 90 + 10).cast("int")), F.when((k + n) % 6 == 0, " Kafka").otherwise(F.lit("")))
    p = p.select("pair_id", "idx", F.floor(n / 3).alias("section"), F.element_at(F.array(*map(F.lit, manifests.TURNS)), (n % 5 + 1).cast("int")).alias("category"), text.alias("text"))
    return manifests.ordered_context(p, p.where("(pair_id + idx) % 5 = 0").select("pair_id", "idx"), 150, ("kafka",))
