"""Queries on concept plans, targets, hybrid search and retained evidence, with the same questions in DuckDB's words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.operators import planning
from siftspark.operators.retrieval import lexical

from .catalogue import plan
from .relations import table

LONG = ("alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega")
QUERY = f"""concat('Experience with ', p_name, ', ', lower(p_type), ' and 3 years; strong JavaScript or {' '.join(LONG)} node', cast(p_partkey % 4 as string))"""
#: In the same words: name, type and a technical name as phrases or items, then each word of the item that is too long.
CONCEPTS = f"""s AS (SELECT p_partkey AS job, unnest([{{'o': 1, 'p': 'required', 'a': replace(lower(p_brand), '#', ' ')}}, {{'o': 2, 'p': 'preferred', 'a': 'size ' || p_size}}, {{'o': 3, 'p': 'context', 'a': 'techjavascript'}},
 {{'o': 4, 'p': 'context', 'a': lower(p_name)}}, {{'o': 5, 'p': 'context', 'a': lower(p_type)}}, {', '.join(f"{{'o': {6 + k}, 'p': 'context', 'a': '{w}'}}" for k, w in enumerate(LONG))}, {{'o': 13, 'p': 'context', 'a': 'node' || p_partkey % 4}}]) AS c FROM part),
 concepts AS (SELECT job, 'SKILLS' AS category, row_number() OVER (PARTITION BY job ORDER BY o) AS ord, p AS priority, a AS alternatives FROM (SELECT job, c.o AS o, c.p AS p, c.a AS a FROM s))"""


def named(skill):
    """A skill without other names."""
    none = F.array().cast("array<string>")
    return F.struct((F.col(skill) if isinstance(skill, str) else skill).alias("canonical"), none.alias("aliases"), none.alias("substitutes"))


def asked(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("job"), F.lit("SKILLS").alias("category"), F.expr(QUERY).alias("query"), F.array(named("p_brand")).alias("required"), F.array(named(F.concat(F.lit("size "), "p_size"))).alias("preferred"),
        F.lit(None).cast("array<array<string>>").alias("degree"),
    )


@plan(f"WITH {CONCEPTS} SELECT * FROM concepts")
def concept_plan(spark, d):
    return planning.concept_plan(asked(spark, d)).drop("substitutes").withColumn("alternatives", F.array_distinct(F.col("alternatives"))[0])


@plan(f"""WITH {CONCEPTS} SELECT * FROM concepts UNION ALL SELECT p_partkey, 'SKILLS', (SELECT max(ord) FROM concepts c WHERE c.job = p_partkey) + n, CASE WHEN p_partkey % 3 = 0 THEN 'preferred' ELSE 'required' END,
 CASE n WHEN 1 THEN lower(p_name) ELSE 'zeta' END FROM part, (VALUES (1), (2)) v(n)""")
def target_concepts(spark, d):
    p = table(spark, d, "part")
    treatment = F.when(F.col("p_partkey") % 3 == 0, "preference").otherwise("requirement")
    targets = p.select(F.col("p_partkey").alias("job"), F.lit("SKILLS").alias("category"), F.lit("t").alias("target_id"), treatment.alias("treatment"), F.array(F.array("p_name"), F.array(F.lit("Zeta"))).alias("groups"))
    return planning.target_concepts(planning.concept_plan(asked(spark, d)), targets).withColumn("alternatives", F.col("alternatives")[0])


@plan("""SELECT o_orderkey AS query, coalesce(c.n, 0) AS concepts, coalesce(d, 0) AS dense_hits, coalesce(s, 0) AS sparse_hits, coalesce(f, 0) AS fused_hits, coalesce(r, 0) AS returned_hits, coalesce(rs, 0) AS returned_sparse_hits
FROM (SELECT o_orderkey, 1 + o_orderkey % 4 AS n FROM orders) c LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_partkey % 3 <> 0) AS d, count(*) FILTER (l_suppkey % 2 = 0) AS s, count(*) AS f, count(*) FILTER (l_linenumber <= 2) AS r,
 count(*) FILTER (l_linenumber <= 2 AND l_suppkey % 2 = 0) AS rs FROM lineitem GROUP BY 1) h ON l_orderkey = o_orderkey""")
def retrieval_counts(spark, d):
    concepts = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), F.explode(F.sequence(F.lit(0), F.col("o_orderkey") % 4)))
    hits = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query"), F.when(F.col("l_partkey") % 3 != 0, 1).alias("dense_rank"), F.when(F.col("l_suppkey") % 2 == 0, 1).alias("sparse_rank"), (F.col("l_linenumber") <= 2).alias("returned")
    )
    return planning.retrieval_counts(concepts, hits, "query")


WANTED = [("the", "required", ("the",)), ("der", "required", ("der", "die")), ("la", "preferred", ("la",)), ("of the", "context", ("of the", "de la"))]


@plan("""WITH c AS (SELECT label, vec_id AS id, embedding::DOUBLE[] AS v, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS p FROM embeddings JOIN documents ON vec_id = doc_id),
 q AS (SELECT label, arg_min(v, id) AS q FROM c GROUP BY label),
 d AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY round(list_cosine_similarity(v, q), 4) DESC, id) AS dense_rank FROM c JOIN q USING (label)),
 h AS (SELECT label, id, contains(p, ' the ')::INT + (contains(p, ' der ') OR contains(p, ' die '))::INT AS a, contains(p, ' la ')::INT AS b, (contains(p, ' of the ') OR contains(p, ' de la '))::INT AS e FROM c),
 s AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY a DESC, b DESC, e DESC, id) AS sparse_rank FROM h WHERE a + b + e > 0),
 f AS (SELECT label, id, dense_rank, sparse_rank, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + sparse_rank), 0), 6) AS rrf FROM (SELECT * FROM d WHERE dense_rank <= 10) FULL JOIN (SELECT * FROM s WHERE sparse_rank <= 10) USING (label, id))
SELECT *, row_number() OVER (PARTITION BY label ORDER BY rrf DESC, id) AS place FROM f""".replace("\\\\", "\\"))
def hybrid_search(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    chunks = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v")).join(texts, "id")
    chunks = chunks.select("label", "id", "v", lexical(F.col("text")).alias("lexical"))  # of the texts that have a vector only
    queries = chunks.groupBy("label").agg(F.min_by("v", "id").alias("q"))
    return planning.hybrid(chunks, queries, WANTED, "label")


CHUNKS = "l_orderkey AS doc_id, (['SKILLS', 'EXPERIENCE', 'PROJECTS', 'EDUCATION'])[l_partkey % 4 + 1] AS category, l_linenumber AS chunk_id"
SCOPE = "(VALUES ('SKILLS', 'SKILLS', 0), ('SKILLS', 'EXPERIENCE', 1), ('SKILLS', 'PROJECTS', 2), ('EXPERIENCE', 'EXPERIENCE', 0), ('EXPERIENCE', 'PROJECTS', 1), ('PROJECTS', 'PROJECTS', 0), ('PROJECTS', 'EXPERIENCE', 1), ('EDUCATION', 'EDUCATION', 0)) s(wanted, category, place)"


def _chunks(spark, d):
    """The distinct chunks, each document's in one task and in order: rows go there as they are, since a scan's own share of the distinct rows is nearly all rows, held at once."""
    kinds = F.element_at(F.array(*map(F.lit, planning.CATEGORIES)), (F.col("l_partkey") % 4 + 1).cast("int"))
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), kinds.alias("category"), F.col("l_linenumber").alias("chunk_id")).repartition("doc_id")
    once = Window.partitionBy("doc_id", "chunk_id", "category").orderBy("category")
    return x.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")


@plan(f"""WITH c AS (SELECT DISTINCT {CHUNKS} FROM lineitem), x AS (SELECT doc_id, wanted, place, chunk_id FROM c JOIN {SCOPE} USING (category))
SELECT * FROM x UNION ALL SELECT c.doc_id, w.wanted, -1, c.chunk_id FROM c, (SELECT DISTINCT wanted FROM {SCOPE}) w WHERE c.category = 'EXPERIENCE' AND NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = c.doc_id AND x.wanted = w.wanted)""")
def scope_fallback(spark, d):
    return planning.in_scope(_chunks(spark, d), "EXPERIENCE")


@plan(f"""WITH c AS (SELECT DISTINCT {CHUNKS} FROM lineitem), x AS (SELECT doc_id, wanted, place, chunk_id FROM c JOIN {SCOPE} USING (category))
SELECT doc_id, wanted, chunk_id, min(place) AS place FROM x GROUP BY ALL""")
def scope_hits(spark, d):
    return planning.in_scope(_chunks(spark, d), once=True)


@plan("""WITH h AS (SELECT l_orderkey AS pair_id, l_linenumber AS hit, max(l_quantity) AS score, max(l_partkey % 3) / 2 AS c0, max(l_suppkey % 3) / 2 AS c1 FROM lineitem GROUP BY ALL),
 r AS (SELECT pair_id, hit FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, hit) AS n FROM h) WHERE n <= 2),
 b AS (SELECT pair_id, hit FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY c0 DESC, hit) AS n FROM h WHERE c0 > 0) WHERE n = 1 UNION SELECT pair_id, hit FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY c1 DESC, hit) AS n FROM h WHERE c1 > 0) WHERE n = 1)
SELECT *, 'reranked' AS kept FROM r UNION ALL SELECT *, 'target' FROM (SELECT * FROM b EXCEPT SELECT * FROM r)""")
def retained_evidence(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("hit")).agg(
        F.max("l_quantity").alias("score"), (F.max(F.col("l_partkey") % 3) / 2).alias("c0"), (F.max(F.col("l_suppkey") % 3) / 2).alias("c1")
    )
    cover = h.select("pair_id", "hit", F.expr("stack(2, 0, c0, 1, c1) as (target, coverage)"))
    return planning.retained(h.select("pair_id", "hit", "score"), cover)


@plan("""WITH j AS (SELECT p_brand AS job, list_sort(list_distinct(list(p_type))) AS skills, max(p_size) AS n FROM part GROUP BY 1),
 q AS (SELECT job, unnest([{'c': 'SKILLS', 't': CASE WHEN n % 2 = 0 THEN 'cut ' || job END}, {'c': 'EXPERIENCE', 't': CASE WHEN n % 3 = 0 THEN 'weld' END}, {'c': 'PROJECTS', 't': CASE WHEN n % 5 = 0 THEN 'build' ELSE 'Projects demonstrating hands-on experience with ' || array_to_string(skills, ', ') END},
  {'c': 'EDUCATION', 't': 'Education and certifications stated in the CV'}]) AS x FROM j),
 t AS (SELECT p_brand AS job, 'EXPERIENCE' AS c, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS t FROM part WHERE p_size > 25 GROUP BY 1)
SELECT job, category, texts FROM (SELECT q.job, x.c AS category, coalesce(t.t, x.t) AS texts FROM q LEFT JOIN t ON t.job = q.job AND t.c = x.c) WHERE texts IS NOT NULL""")
def retrieval_queries(spark, d):
    j = table(spark, d, "part").groupBy(F.col("p_brand").alias("job")).agg(F.sort_array(F.collect_set("p_type")).alias("skills"), F.max("p_size").alias("n"))
    queries = F.create_map(
        F.lit("SKILLS"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("cut "), "job")).otherwise(F.lit("")), F.lit("EXPERIENCE"), F.when(F.col("n") % 3 == 0, "weld").otherwise("No explicit requirement."),
        F.lit("PROJECTS"), F.when(F.col("n") % 5 == 0, "build").otherwise(F.lit(" ")),
    )
    t = table(spark, d, "part").where("p_size > 25").select(F.col("p_brand").alias("job"), F.lit("EXPERIENCE").alias("category"), F.col("p_name").alias("ord"), F.col("p_name").alias("text"))
    return planning.retrieval_queries(j.select("job", queries.alias("queries"), "skills"), t).withColumn("texts", F.array_join("texts", "|"))


@plan("""WITH p AS (SELECT p_partkey AS job, p_partkey % 4 AS k, p_partkey % 3 AS s, p_name AS name FROM part),
 a AS (SELECT job, 'a1' AS target_id, CASE k WHEN 0 THEN 'SKILLS' WHEN 1 THEN 'EXPERIENCE' ELSE 'PROJECTS' END AS category, 'x' AS kind, CASE WHEN k = 3 THEN 'preference' ELSE 'requirement' END AS treatment, name AS text, 'approved' AS origin, 2 AS groups FROM p),
 e AS (SELECT job, category FROM a WHERE treatment = 'requirement'), need AS (SELECT job, n, 'need' || n AS name FROM p, (VALUES (0), (1)) v(n) WHERE s > 0), nice AS (SELECT job, 0 AS n, 'nice' AS name FROM p)
SELECT * FROM a UNION ALL SELECT job, CASE WHEN job IN (SELECT job FROM e WHERE category = 'EXPERIENCE') THEN 'derived_delivery_' ELSE 'derived_experience_' END || n, 'EXPERIENCE', 'experience', 'requirement', 'Hands-on delivery using ' || name, 'derived', 1 FROM need
UNION ALL SELECT job, 'derived_skills_' || n, 'SKILLS', 'skill', 'requirement', name, 'derived', 1 FROM need WHERE job NOT IN (SELECT job FROM e WHERE category = 'SKILLS')
UNION ALL SELECT job, 'derived_preferred_0', 'SKILLS', 'skill', 'preference', name, 'derived', 1 FROM nice WHERE job IN (SELECT job FROM need) AND job NOT IN (SELECT job FROM e WHERE category = 'SKILLS')
UNION ALL SELECT job, 'legacy_skills', 'SKILLS', 'skill', 'requirement', name, 'derived', 2 FROM p WHERE s = 0 AND k <> 0
UNION ALL SELECT job, 'legacy_education', 'EDUCATION', 'education', 'requirement', 'brass ' || name, 'derived', 3 FROM p""")
def resolve_targets(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("job"), (F.col("p_partkey") % 4).alias("k"), (F.col("p_partkey") % 3).alias("s"), F.col("p_name").alias("name"))
    category = F.when(F.col("k") == 0, "SKILLS").when(F.col("k") == 1, "EXPERIENCE").otherwise("PROJECTS")
    approved = p.select(
        "job", F.lit("a1").alias("target_id"), category.alias("category"), F.lit("x").alias("kind"), F.when(F.col("k") == 3, "preference").otherwise("requirement").alias("treatment"), F.col("name").alias("text"),
        F.array(F.array("name"), F.array(F.lit("y"))).alias("groups"),
    )
    skill = lambda n, name, w: F.struct(F.lit(n).alias("no"), F.lit(name).alias("name"), F.lit(w).alias("wanted"))
    some = F.when(F.col("s") > 0, F.array(skill(0, "need0", "required"), skill(1, "need1", "required"), skill(0, "nice", "preferred"))).otherwise(F.array(skill(0, "nice", "preferred")))
    none = F.lit(None).cast("array<string>")
    skills = p.select("job", F.explode(some).alias("k")).select("job", "k.*", none.alias("aliases"), none.alias("substitutes"))
    asks = {"SKILLS": F.col("name"), "EXPERIENCE": F.lit("5 years of it"), "PROJECTS": F.lit("No explicit requirement"), "EDUCATION": F.concat(F.lit("brass "), "name")}
    q = p.select("job", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), v.alias("query")) for c, v in asks.items()])).alias("q")).select("job", "q.*")
    none = F.lit(None).cast(f"array<{planning.SKILL}>")
    plan_ = planning.concept_plan(q.withColumns({"required": none, "preferred": none, "degree": F.lit(None).cast("array<array<string>>")}))
    return planning.resolved_targets(approved, skills, q, plan_).drop("substitutes", "importance").withColumn("groups", F.size("groups"))
