"""Retrieval as a chain of tables: profiles to concepts, concepts to ranked texts, targets to evidence and scores, for all profiles at once.

Each source of the documents is a job. Its profile (skills with other names and substitutes, a
degree, queries, approved targets) is made of the words of one of its documents, so nothing here is
written by hand. The SQL makes the same profiles and computes the rest in its own way: lexical forms
by nested replacements, phrases by looking into padded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators import phrases, planning, sections
from siftspark.operators.coverage import coverage_scores
from siftspark.operators.ranking import reciprocal_rank_fusion
from siftspark.operators.retrieval import REWRITES, cosine_to, lexical, norm
from siftspark.operators.skills import GROUPS, NEGATIONS, VERBS
from siftspark.sources.shared import stored

from .catalogue import plan
from .relations import table

WORDS, LONG_ENOUGH = 40, 500
KIND_OF = "element_at(array('SKILLS', 'EXPERIENCE', 'PROJECTS', 'EDUCATION'), cast(doc_id % 4 + 1 as int))"

# ---- the same questions in SQL


def _lex(x: str) -> str:
    """lexical() in DuckDB; patterns are applied twice, since neighbouring names share the character between them."""
    x = f"replace(lower({x}), 'ß', 'ss')"
    for pattern, token in REWRITES:
        name = pattern.removeprefix(r"(?<!\w)").removesuffix(r"(?!\w)")
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_]){name}($|[^\p{{L}}\p{{N}}_])', '\1{token}\2', 'g')"
    return rf"array_to_string(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+'), ' ')"


def _spelled(source: str, to: str) -> str:
    """Lists of terms (job, category, part, pos, priority, terms, subs) to concepts with the lexical forms of all their spellings."""
    of = "job, category, part, pos, priority"
    return f"""{to}_a AS (SELECT {of}, 'a' AS kind, generate_subscripts(terms, 1) AS nth, unnest(terms) AS term FROM {source} UNION ALL SELECT {of}, 's', generate_subscripts(subs, 1), unnest(subs) FROM {source}),
 {to}_b AS (SELECT * FROM {to}_a UNION ALL SELECT {of}, kind, 1000 + 10 * g.g + g.k, g.name FROM (SELECT DISTINCT {of}, kind, n.g FROM {to}_a JOIN names n ON lower(term) = lower(n.name)) x JOIN names g ON g.g = x.g),
 {to}_c AS (SELECT {of}, kind, phrase, min(nth) AS nth FROM (SELECT *, {_lex('term')} AS phrase FROM {to}_b) WHERE phrase <> '' GROUP BY ALL),
 {to} AS (SELECT {of}, coalesce(list(phrase ORDER BY nth) FILTER (kind = 'a'), []) AS alternatives, coalesce(list(phrase ORDER BY nth) FILTER (kind = 's'), []) AS substitutes FROM {to}_c GROUP BY ALL HAVING len(alternatives) > 0)"""


_NAMES = ", ".join(f"({g}, {k}, '{name}')" for g, names in enumerate(GROUPS) for k, name in enumerate(names))
_MENTIONED = " UNION ALL ".join(
    rf"SELECT job, category, 2, {g}, 'context', ['{names[0]}'], [] FROM asking WHERE " + " OR ".join(rf"regexp_matches(query, '(?i)(^|[^\p{{L}}\p{{N}}_]){planning.mentioned_part(n)}($|[^\p{{L}}\p{{N}}_])')" for n in names)
    for g, names in enumerate(GROUPS)
)
_STOP = rf"(?:{'|'.join(planning.STOP_WORDS)}|\d+)"
PROFILES = f"""names(g, k, name) AS (VALUES {_NAMES}),
 texts AS (SELECT doc_id, lang, source, text, {_lex("text")} AS lex FROM documents),
 w AS (SELECT source AS job, list_slice(list_concat(string_split(arg_min(lex, doc_id), ' '), list_transform(range(1, {WORDS + 1}), lambda i: 'pad' || i)), 1, {WORDS}) AS w FROM texts WHERE length(text) >= {LONG_ENOUGH} AND source IS NOT NULL GROUP BY 1),
 queries AS (SELECT job, unnest(['SKILLS', 'EXPERIENCE', 'PROJECTS', 'EDUCATION']) AS category,
   unnest(['Experience with ' || w[8] || ' ' || w[9] || ', the ' || w[10] || ' or JavaScript and "' || w[11] || ' ' || w[12] || '"; machine learning ' || array_to_string(w[13:20], ' ') || ', and 3 years', 'No explicit requirement', array_to_string(w[21:28], ' '), 'No explicit requirement']) AS query FROM w),
 asking AS (SELECT * FROM queries WHERE trim(query) <> '' AND NOT contains(lower(query), 'no explicit requirement')),
 skills AS (SELECT job, w, unnest(['required', 'required', 'preferred']) AS priority, unnest([0, 1, 0]) AS pos, unnest([[w[1] || ' ' || w[2], w[3]], ['Postgres', w[6]], [w[7]]]) AS terms, unnest([[w[4] || ' ' || w[5]], ['K8s'], []::VARCHAR[]]) AS subs FROM w)"""
PLAN = (
    rf"""{PROFILES},
 c0 AS (SELECT job, category, CASE priority WHEN 'required' THEN 0 ELSE 1 END AS part, pos, priority, terms, subs FROM skills, (VALUES ('SKILLS'), ('EXPERIENCE'), ('PROJECTS')) v(category)
  UNION ALL SELECT job, 'EDUCATION', 0, unnest([0, 1]), 'required', unnest([['BACHELOR', w[29]], [w[30] || ' ' || w[31], w[32], w[33]]]), [] FROM w
  UNION ALL {_MENTIONED}
  UNION ALL SELECT job, category, 3, pos, 'context', [m[pos]], [] FROM (SELECT *, unnest(range(1, len(m) + 1)) AS pos FROM (SELECT *, regexp_extract_all(query, '(?i)\b({planning.COMPOUNDS})\b') AS m FROM asking))
  UNION ALL SELECT job, category, 4, pos, 'context', [m[pos]], [] FROM (SELECT *, unnest(range(1, len(m) + 1)) AS pos FROM (SELECT *, regexp_extract_all(query, '"([^"\n]{{1,120}})"', 1) AS m FROM asking))
  UNION ALL SELECT job, category, 5, pos, 'context', [item], [] FROM (SELECT job, category, pos, trim(regexp_replace(regexp_replace({_lex("m[pos]")}, '^(?:{_STOP}(?: |$))+', ''), '(?:(?:^| ){_STOP})+$', '')) AS item
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS pos FROM (SELECT *, string_split_regex(query, '(?i)[,;]|\b(?:and|or)\b') AS m FROM asking WHERE regexp_matches(query, '[,;]')))) WHERE item <> '' AND len(string_split(item, ' ')) <= {planning.ITEM_WORDS}),
 """
    + _spelled("c0", "c1")
    + rf""",
 c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY job, category, alternatives ORDER BY part, pos) = 1),
 covered AS (SELECT DISTINCT job, category, unnest(string_split(array_to_string(list_concat(alternatives, substitutes), ' '), ' ')) AS word FROM c2),
 words AS (SELECT job, category, word, min(pos) AS pos FROM (SELECT job, category, generate_subscripts(s, 1) AS pos, unnest(s) AS word FROM (SELECT *, string_split({_lex("query")}, ' ') AS s FROM asking)) GROUP BY ALL),
 c3 AS (SELECT job, category, 6 AS part, pos, 'context' AS priority, [word] AS terms, []::VARCHAR[] AS subs FROM words WHERE word <> '' AND NOT regexp_full_match(word, '{_STOP}') AND (job, category, word) NOT IN (SELECT job, category, word FROM covered)),
 """
    + _spelled("c3", "c4")
    + f""",
 c5 AS (SELECT *, count(*) FILTER (part < 6) OVER (PARTITION BY job, category) AS named FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c4) QUALIFY row_number() OVER (PARTITION BY job, category, alternatives ORDER BY part, pos) = 1),
 concepts AS (SELECT job, category, ord, priority, alternatives, substitutes FROM (SELECT *, row_number() OVER (PARTITION BY job, category ORDER BY part, pos) AS ord FROM c5)
  WHERE ord <= CASE WHEN part < 6 THEN {planning.ALL} ELSE least({planning.ALL}, greatest({planning.WORDS}, named + 1)) END)"""
)


# ---- the chain in Spark


def texts_of(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("long"), "lang", "source", "text")


def job_profiles(texts: DataFrame) -> DataFrame:
    """One profile for each source, of the first 40 words of its first long document."""
    base = texts.where(f"length(text) >= {LONG_ENOUGH} and source is not null").groupBy(F.col("source").alias("job")).agg(F.min_by("text", "doc_id").alias("text"))
    base = base.select("job", lexical(F.col("text")).alias("lexical"))
    w = F.slice(F.concat(F.split("lexical", " "), F.transform(F.sequence(F.lit(1), F.lit(WORDS)), lambda i: F.concat(F.lit("pad"), i))), 1, WORDS)
    none = "cast(array() as array<string>)"
    x = base.select("job", w.alias("w")).selectExpr(
        "job", "w",
        f"array(named_struct('canonical', concat(w[0], ' ', w[1]), 'aliases', array(w[2]), 'substitutes', array(concat(w[3], ' ', w[4]))), named_struct('canonical', 'Postgres', 'aliases', array(w[5]), 'substitutes', array('K8s'))) as required",
        f"array(named_struct('canonical', w[6], 'aliases', {none}, 'substitutes', {none})) as preferred",
        "'BACHELOR' as level", "array(w[28]) as level_aliases", "array(concat(w[29], ' ', w[30]), w[31]) as fields", "array(w[32]) as field_aliases",
        "map('SKILLS', concat('Experience with ', w[7], ' ', w[8], ', the ', w[9], ' or JavaScript and \"', w[10], ' ', w[11], '\"; machine learning ', array_join(slice(w, 13, 8), ' '), ', and 3 years'), 'EXPERIENCE', 'No explicit requirement', "
        "'PROJECTS', array_join(slice(w, 21, 8), ' '), 'EDUCATION', 'No explicit requirement') as queries",
    )
    return stored(x, "profiles")


def job_queries(profiles: DataFrame) -> DataFrame:
    return profiles.select("job", F.explode("queries").alias("category", "query"))


def job_concepts(profiles: DataFrame) -> DataFrame:
    return stored(planning.profile_plan(profiles, job_queries(profiles)), "concepts")


@plan(f"WITH {PLAN} SELECT job, category, ord, priority, array_to_string(alternatives, '|') AS alternatives, array_to_string(substitutes, '|') AS substitutes FROM concepts")
def job_concept_plans(spark, d):
    """The concepts of every job's queries, with other names and substitutes of skills and degrees."""
    x = job_concepts(job_profiles(texts_of(spark, d)))
    return x.withColumns({c: F.array_join(c, "|") for c in ("alternatives", "substitutes")})


_SCOPE = "(VALUES ('SKILLS', 'SKILLS'), ('SKILLS', 'EXPERIENCE'), ('SKILLS', 'PROJECTS'), ('EXPERIENCE', 'EXPERIENCE'), ('EXPERIENCE', 'PROJECTS'), ('PROJECTS', 'PROJECTS'), ('PROJECTS', 'EXPERIENCE'), ('EDUCATION', 'EDUCATION')) s(category, part)"


@plan(f"""WITH {PLAN},
 chunks AS (SELECT t.doc_id AS id, s.category, coalesce(lang, '') AS lang, source, embedding::DOUBLE[] AS v, ' ' || lex || ' ' AS p FROM texts t JOIN embeddings ON vec_id = t.doc_id JOIN {_SCOPE} ON s.part = (['SKILLS', 'EXPERIENCE', 'PROJECTS', 'EDUCATION'])[t.doc_id % 4 + 1]),
 qv AS (SELECT source AS job, arg_min(v, id) AS q FROM chunks GROUP BY 1),
 d AS (SELECT job, category, lang, id, row_number() OVER (PARTITION BY job, category, lang ORDER BY round(list_cosine_similarity(v, q), 4) DESC, id) AS dense_rank FROM chunks JOIN queries USING (category) JOIN qv USING (job)),
 ph AS (SELECT DISTINCT job, category, ord, priority, unnest(list_concat(alternatives, substitutes)) AS phrase FROM concepts),
 asked AS (SELECT DISTINCT phrase FROM ph), docs AS (SELECT DISTINCT id, p FROM chunks), held AS (SELECT id, phrase FROM docs, asked WHERE contains(p, ' ' || phrase || ' ')),
 h AS (SELECT job, category, c.lang, id, count(DISTINCT ord) FILTER (priority = 'required') AS a, count(DISTINCT ord) FILTER (priority = 'preferred') AS b, count(DISTINCT ord) FILTER (priority = 'context') AS e
  FROM held JOIN ph USING (phrase) JOIN chunks c USING (id, category) GROUP BY ALL),
 s AS (SELECT job, category, lang, id, a, b, e, row_number() OVER (PARTITION BY job, category, lang ORDER BY a DESC, b DESC, e DESC, id) AS sparse_rank FROM h),
 f AS (SELECT job, category, lang, id, dense_rank, sparse_rank, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + sparse_rank), 0), 6) AS rrf FROM (SELECT * FROM d WHERE dense_rank <= 10) FULL JOIN (SELECT * FROM s WHERE sparse_rank <= 10) USING (job, category, lang, id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job, category, lang ORDER BY rrf DESC, id) AS place FROM f) WHERE place <= 20""")
def concept_search(spark, d):
    """Every job's queries against the chunks of their categories in each language: concepts and vectors, fused. Chunks are the documents that have a vector."""
    texts = texts_of(spark, d)
    profiles = job_profiles(texts)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    own = texts.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), "source", F.expr(KIND_OF).alias("part"), "doc_id").join(vectors, "doc_id").drop("doc_id")
    own = stored(own, "chunks")  # without texts: those are read once, by the index
    scoped = planning.in_scope(own.select(F.lit(0).alias("doc_id"), F.col("part").alias("category"), F.struct("id", "lang").alias("chunk_id")))
    scoped = scoped.select(F.col("wanted").alias("category"), "chunk_id.*")
    wanted = own.where("source is not null").groupBy(F.col("source").alias("job")).agg(F.min_by("v", "id").alias("q")).join(job_queries(profiles).select("job", "category"), "job")
    x = scoped.join(own.select("id", "v", norm(F.col("v")).alias("_n")), "id").join(phrases.sent(wanted.withColumn("_qn", norm(F.col("q")))), "category")
    x = x.select("job", "category", "lang", "id", F.round(cosine_to(F.col("v"), F.col("_n"), F.col("q"), F.col("_qn")), 4).alias("score"))
    dense = planning.best_of(x, ["job", "category", "lang"], [F.desc("score"), "id"], "dense_rank")
    concepts = job_concepts(profiles)
    index = phrases.phrase_index(texts.join(own.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), lexical(F.col("text")).alias("lexical")), concepts.select(F.explode(F.concat("alternatives", "substitutes")).alias("phrase")))
    hits = phrases.concept_hits(index, concepts).join(scoped, ["category", "id"])
    sparse = phrases.concept_top(hits, 10, ("job", "category", "lang"))
    return reciprocal_rank_fusion(dense, sparse, ["job", "category", "lang"], "id").where("place <= 20").select("job", "category", "lang", "id", "dense_rank", "sparse_rank", "rrf", "place")


#: Approved targets of a job, in both languages: id, category, kind, treatment, text, groups, substitutes, importance. The degree of the profile replaces the groups of the second.
TARGETS = """named_struct('target_id', 'a1', 'category', 'PROJECTS', 'kind', 'skill', 'treatment', 'requirement', 'text', concat(w[9], ' ', w[10]), 'groups', array(array(w[11]), array(w[12], w[13]), array(concat(w[14], ' ', w[15]))), 'substitutes', array(w[16]), 'importance', 2),
 named_struct('target_id', 'a2', 'category', 'EDUCATION', 'kind', 'education', 'treatment', 'requirement', 'text', concat('A bachelor in ', w[30]), 'groups', array(array(w[17])), 'substitutes', cast(array() as array<string>), 'importance', 1),
 named_struct('target_id', 'a3', 'category', 'SKILLS', 'kind', 'skill', 'treatment', 'preference', 'text', w[18], 'groups', array(array(w[18])), 'substitutes', cast(array() as array<string>), 'importance', 1)"""
ASSESSED = f"""{PROFILES},
 t0 AS (SELECT job, 'a1' AS target_id, 'PROJECTS' AS category, 'skill' AS kind, 'requirement' AS treatment, 2 AS importance, 'approved' AS origin, [[w[12]], [w[13], w[14]], [w[15] || ' ' || w[16]]] AS groups, [w[17]] AS subs FROM w
  UNION ALL SELECT job, 'a2', 'EDUCATION', 'education', 'requirement', 1, 'approved', [['Bachelor', w[29]], [w[30] || ' ' || w[31], w[32], w[33]]], [] FROM w UNION ALL SELECT job, 'a3', 'SKILLS', 'skill', 'preference', 1, 'approved', [[w[19]]], [] FROM w
  UNION ALL SELECT job, 'derived_skills_' || pos, 'SKILLS', 'skill', 'requirement', 1, 'derived', [terms], subs FROM skills WHERE priority = 'required' UNION ALL SELECT job, 'derived_preferred_' || pos, 'SKILLS', 'skill', 'preference', 1, 'derived', [terms], [] FROM skills WHERE priority = 'preferred'
  UNION ALL SELECT job, 'derived_experience_' || pos, 'EXPERIENCE', 'experience', 'requirement', 1, 'derived', [terms], subs FROM skills WHERE priority = 'required'),
 g0 AS (SELECT job, target_id, generate_subscripts(groups, 1) AS g, unnest(groups) AS terms FROM t0 UNION ALL SELECT job, target_id, -1, subs FROM t0),
 g1 AS (SELECT job, target_id, g, unnest(terms) AS term FROM g0), g2 AS (SELECT * FROM g1 UNION SELECT job, target_id, g1.g, m.name FROM g1 JOIN names n ON lower(term) = lower(n.name) JOIN names m ON m.g = n.g),
 g3 AS (SELECT DISTINCT job, target_id, g, unnest([x, replace(x, ' ', '')]) AS phrase FROM (SELECT *, {_lex("term")} AS x FROM g2)),
 lines AS (SELECT doc_id, source AS job, (['SKILLS', 'EXPERIENCE', 'PROJECTS', 'EDUCATION'])[doc_id % 4 + 1] AS part, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, source, string_split_regex(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(10) || '\\2', 'g'), '[\\n;]') AS s FROM texts)),
 fine AS (SELECT *, ' ' || {_lex("line")} || ' ' AS p, regexp_matches(line, '(?i)\\b({'|'.join(VERBS)})\\b') AND part IN ('EXPERIENCE', 'PROJECTS') AS acts FROM lines WHERE NOT regexp_matches(line, '(?i)\\b({'|'.join(NEGATIONS)})\\b')),
 hit AS (SELECT doc_id, n, job, target_id, count(DISTINCT g) FILTER (g > 0) AS n_groups FROM fine f JOIN g3 USING (job) WHERE contains(p, ' ' || phrase || ' ') GROUP BY ALL),
 cov AS (SELECT hit.*, line, CASE WHEN n_groups = 0 THEN 0.5 ELSE n_groups / len(groups) END::DOUBLE AS coverage FROM hit JOIN t0 USING (job, target_id) JOIN fine USING (doc_id, n) JOIN {_SCOPE} ON s.category = t0.category AND s.part = fine.part WHERE kind NOT IN ('experience', 'responsibility', 'project') OR acts),
 best AS (SELECT * FROM cov QUALIFY row_number() OVER (PARTITION BY doc_id, job, target_id ORDER BY coverage DESC, n) = 1),
 assessed AS (SELECT t.doc_id AS pair_id, t0.job, t0.target_id, t0.category, kind, treatment, importance, coalesce(coverage, 0) AS coverage, coalesce(n_groups = 0, false) AS accepted_substitute, coalesce(n_groups, 0) AS n_groups, trim(line) AS passage,
  CASE WHEN coverage IS NULL THEN 'MISSING_INFORMATION' WHEN coverage = 1 AND n_groups > 0 THEN 'DIRECT' ELSE 'PARTIAL' END AS status FROM texts t JOIN t0 ON t0.job = t.source LEFT JOIN best ON best.doc_id = t.doc_id AND best.job = t0.job AND best.target_id = t0.target_id)"""


def assessed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every document against all targets of its source's profile, and the passages."""
    texts = texts_of(spark, d)
    profiles = job_profiles(texts)
    approved = profiles.selectExpr("job", f"inline(array({TARGETS}))")
    targets = planning.resolved_targets(approved, planning.profile_skills(profiles), job_queries(profiles), job_concepts(profiles))
    targets = stored(phrases.with_degrees(targets, profiles), "targets")
    p = sections.passages(texts.select(F.struct("doc_id", "source").alias("doc_id"), "text"))
    p = p.select(F.struct("doc_id.doc_id", "passage_no").alias("id"), F.struct("doc_id.doc_id", "doc_id.source").alias("doc_id"), F.lit(0).alias("chunk_no"), "passage_no", "passage", lexical(F.col("passage")).alias("lexical"), "doc_id.doc_id")
    p = p.toDF("id", "doc", "chunk_no", "passage_no", "passage", "lexical", "doc_id").withColumn("category", F.expr(KIND_OF)).drop("doc_id").withColumnRenamed("doc", "doc_id")
    covered = phrases.target_coverage(p, targets, own="doc_id.source")
    pairs = texts.where("source is not null").select(F.col("doc_id").alias("pair_id"), F.col("source").alias("job"), F.struct("doc_id", "source").alias("doc_id"))
    return phrases.pair_assessments(pairs, targets, covered).drop("doc_id", "origin"), p


@plan(f"WITH {ASSESSED} SELECT * FROM assessed")
def target_evidence(spark, d):
    """The best passage of every document for every target of its job: groups that are all asked for, substitutes, degrees in place of their own groups."""
    return phrases.with_passages(*assessed(spark, d)).withColumn("passage", F.trim("passage"))


@plan(f"""WITH {ASSESSED},
 cat AS (SELECT pair_id, category, sum(importance * coverage) FILTER (treatment <> 'preference') / sum(importance) FILTER (treatment <> 'preference') AS main, sum(importance * coverage) FILTER (treatment = 'preference') / sum(importance) FILTER (treatment = 'preference') AS extra FROM assessed GROUP BY ALL),
 sc AS (SELECT pair_id, sum(CASE WHEN main IS NOT NULL THEN wt * CASE WHEN extra IS NULL THEN main ELSE least(1, main + 0.1 * extra) END END) / sum(wt) FILTER (main IS NOT NULL) AS score FROM cat JOIN (VALUES ('SKILLS', 0.3::DOUBLE), ('EXPERIENCE', 0.4::DOUBLE), ('PROJECTS', 0.15::DOUBLE), ('EDUCATION', 0.15::DOUBLE)) v(category, wt) USING (category) GROUP BY 1),
 n AS (SELECT pair_id, count(*) FILTER (treatment <> 'preference' AND coverage > 0) AS supported, count(*) FILTER (kind = 'experience') AS asked, count(*) FILTER (kind = 'experience' AND (status = 'DIRECT' OR accepted_substitute OR (coverage >= 0.5 AND n_groups >= 2))) AS proved,
  sum(CASE WHEN kind = 'experience' THEN coverage ELSE 0 END) AS applied_coverage FROM assessed GROUP BY 1)
SELECT pair_id, round(round(score, 9), 6) AS composite_score, CAST(supported AS BIGINT) AS supported, 0.0 AS responsibility_coverage, applied_coverage, supported > 0 AND (asked = 0 OR proved > 0) AND round(score, 6) > 0 AS eligible,
 CASE WHEN NOT (supported > 0 AND (asked = 0 OR proved > 0) AND round(score, 6) > 0) THEN 'INSUFFICIENT_SUPPORTED_RELEVANCE' END AS reason FROM sc JOIN n USING (pair_id)""")
def evidence_scores(spark, d):
    """From profiles to a score for every document: targets, best passages, coverage by category, eligibility."""
    return coverage_scores(assessed(spark, d)[0])
