"""Queries on dated histories, excerpts, windows, prompts and the chunker in SQL, with the same questions in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators import context, sections

from .catalogue import ORACLES, plan
from .relations import profiles, table
from .screening import structural_chunks


@plan("""WITH s AS (SELECT c_custkey AS doc_id, (2012 + c_custkey % 5) * 12 AS a, (2015 + c_custkey % 4) * 12 + 5 AS b, (2014 + c_custkey % 6) * 12 + 2 AS c, (2020 + c_custkey % 3) * 12 + 8 AS d FROM customer),
 o AS (SELECT doc_id, CASE WHEN a <= c THEN a ELSE c END AS a1, CASE WHEN a <= c THEN b ELSE d END AS b1, CASE WHEN a <= c THEN c ELSE a END AS a2, CASE WHEN a <= c THEN d ELSE b END AS b2 FROM s WHERE a <= b AND c <= d AND greatest(b, d) <= 2022 * 12 + 2)
SELECT doc_id, CAST(CASE WHEN a2 <= b1 THEN greatest(b1, b2) - a1 ELSE b1 - a1 + b2 - a2 END AS BIGINT) AS months, CASE WHEN a2 <= b1 THEN 1 ELSE 2 END AS islands FROM o""")
def dated_experience(spark, d):
    return context.dated_history(sections.sections(profiles(spark, d)), (2022, 3))


SOURCE = "No Kafka experience. Built payment APIs in Java and JavaScript only for a course. Led two teams."
CLAIMS = (
    ("Kafka experience", False), ("no  KAFKA experience.", True), ("Built payment APIs", False), ("Built payment APIs in Java and JavaScript only for a course", True), ("Led two", True), ("Led tw", False),
    ("course. Led two teams", False), ("only for a course. Led two teams.", True), ("", False), ("JavaScript only for a course.", True), ("...", False),
)


@plan(f"SELECT c_custkey AS doc_id, ([{', '.join(str(ok).lower() for _, ok in CLAIMS)}])[c_custkey % {len(CLAIMS)} + 1] AS supported FROM customer")
def excerpt_checks(spark, d):
    claim = F.element_at(F.array(*[F.lit(c) for c, _ in CLAIMS]), (F.col("c_custkey") % len(CLAIMS) + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), context.is_excerpt(claim, F.lit(SOURCE)).alias("supported"))


@plan(r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?s).{1,900}\z|.{450,899}\n|.{900}') AS p FROM documents), u AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM p),
 o AS (SELECT doc_id, t, CAST(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM u)
SELECT doc_id, 'UNCLASSIFIED' AS section, stop - length(t) AS start, stop, md5(t) AS digest FROM o WHERE regexp_matches(t, '\S')""")
def context_windows(spark, d):
    x = context.windows(table(spark, d, "documents").select("doc_id", "text"), 900, 450)
    return x.select("doc_id", "section", "start", "stop", F.md5(F.col("text").cast("binary")).alias("digest"))


@plan("""WITH s AS (SELECT l_orderkey AS pair_id, (['SKILLS', 'PROJECTS', 'EXPERIENCE', 'EDUCATION'])[l_suppkey % 4 + 1] AS category, (['S', 'P', 'E', 'D'])[l_suppkey % 4 + 1] AS letter, l_linenumber AS ordinal, 'made <' || l_returnflag || l_partkey % 3 || '> & more' AS text FROM lineitem),
 g AS (SELECT pair_id, text, array_to_string(list_sort(list_distinct(list(letter || ordinal))), ',') AS handles, min({'c': category, 'o': ordinal}) AS first FROM s GROUP BY ALL)
SELECT pair_id, string_agg('[' || handles || '] ' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10) ORDER BY first, '[' || handles || '] ' || text) AS prompt FROM g GROUP BY pair_id""")
def prompt_rows(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("SKILLS", "PROJECTS", "EXPERIENCE", "EDUCATION"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("made <"), "l_returnflag", (F.col("l_partkey") % 3).cast("string"), F.lit("> & more"))
    return context.prompts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), kind.alias("category"), F.col("l_linenumber").alias("ordinal"), text.alias("text")))


@plan(f"SELECT doc_id, chunk_index, text, char_length FROM ({ORACLES[structural_chunks.__name__]})")
def chunk_function(spark, d):
    context.register(spark)
    return spark.sql("SELECT doc_id, c.* FROM {docs} d, LATERAL chunk_text('EXPERIENCE', d.text) c", docs=table(spark, d, "documents"))


PAGES = (
    (1, 0, "' Work Experience: '"), (1, 1, "concat('Engineer ', c_custkey)"), (1, 2, "'2019 - 2020 at X'"), (1, 3, "if(c_custkey % 3 = 0, repeat('y', 500), 'Built things.')"), (2, 0, "'Lead'"), (2, 1, "'since 2021'"),
    (2, 2, "'PROJECTS'"), (2, 3, "concat('Tool | ', c_custkey)"), (2, 4, "'- in use in 2022 by many'"), (3, 0, "'EDUCATION'"), (3, 1, "'Bachelor, 2011'"),
)


@plan("""WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 3 = 0 AS long, 'Engineer ' || c_custkey || ' 2019 - 2020 at X' AS head FROM customer), e AS (
 SELECT doc_id, 'EXPERIENCE' AS section, 0 AS chunk_index, 1 AS page_number, 1 AS block_no, 3 AS blocks, '[Section: EXPERIENCE] ' || head || CASE WHEN long THEN '' ELSE ' Built things.' END AS text FROM c
 UNION ALL SELECT doc_id, 'EXPERIENCE', k, 1, 1, 3, '[Section: EXPERIENCE] ' || head || chr(10) || repeat('y', CASE k WHEN 1 THEN 398 ELSE 102 END) FROM c, (VALUES (1), (2)) v(k) WHERE long
 UNION ALL SELECT doc_id, 'EXPERIENCE', 0, 2, 0, 2, '[Section: EXPERIENCE] since 2021' FROM c UNION ALL SELECT doc_id, 'PROJECTS', 0, 2, 3, 2, '[Section: PROJECTS] Tool | ' || doc_id || ' in use in 2022 by many' FROM c
 UNION ALL SELECT doc_id, 'EDUCATION', 0, 3, 1, 1, '[Section: EDUCATION] Bachelor, 2011' FROM c) SELECT * FROM e""")
def page_chunks(spark, d):
    rows = F.array(*[F.struct(F.lit(p).alias("page_number"), F.lit(b).alias("block_no"), F.expr(t).alias("text")) for p, b, t in PAGES])
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(rows).alias("b")).select("doc_id", "b.*")
    return context.page_chunks(x).drop("entry")
