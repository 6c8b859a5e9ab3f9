"""From the queries of profiles to concepts and targets, and from hits to the evidence that is kept. Profiles are few; hits are joined by key."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import reciprocal_rank_fusion
from .retrieval import dense_top, lexical, loose, sparse_top
from .skills import GROUPS, SCOPES, expanded, mentioned

#: Words that are no concepts, compounds that are one, the words of an empty query, and, for profiles, the most concepts before words stop and in all.
STOP_WORDS = """
a an and or the of in on to for with by as at from is are be have has required preferred requirement requirements experience experienced demonstrating hands hands-on
projects project skills skill knowledge strong good excellent ability working work developer development years year explicit no not minimum must should candidate candidates
including using proficiency proficient familiarity familiar relevant degree education section
""".split()
COMPOUNDS = "spring boot|computer science|software engineering|machine learning|data engineering|quality assurance|test automation|rest apis?"
NOTHING, WORDS, ALL, ITEM_WORDS, LEGACY_GROUPS = "no explicit requirement", 64, 128, 6, 8
#: Texts of derived queries and targets.
PROJECTS, DELIVERY, EDUCATION = "Projects demonstrating hands-on experience", "Hands-on delivery using ", "Education and certifications stated in the CV"
CATEGORIES = ("SKILLS", "EXPERIENCE", "PROJECTS", "EDUCATION")
KINDS = {"SKILLS": "skill", "EXPERIENCE": "experience", "PROJECTS": "project", "EDUCATION": "education"}

#: What a profile says of a skill.
SKILL = "struct<canonical: string, aliases: array<string>, substitutes: array<string>>"

_STOP = rf"(?:{'|'.join(STOP_WORDS)}|\d+)"


def mentioned_part(name: str) -> str:
    """The pattern of a name without what may stand around it."""
    return loose(name).removeprefix(r"(?<!\w)").removesuffix(r"(?!\w)")


def best_of(rows: DataFrame, keys: list[str], order: list, rank: str, k: int = 10) -> DataFrame:
    """The k first rows of each key, with their rank."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def grown(rows: DataFrame) -> DataFrame:
    """A table with rows for every query or job. Its size is guessed from compressed files, far too small after an explode, so it is joined by a sorted shuffle and never sent through the driver."""
    return rows.hint("merge")


def _asks(query: Column) -> Column:
    return (F.trim(query) != "") & ~F.contains(F.lower(query), F.lit(NOTHING))


def alternatives(rows: DataFrame, keys: list[str], terms: str, to: str, others: str | None = None) -> DataFrame:
    """Adds to: the lexical forms of all spellings of an array of terms, in order, each once; rows without any go. others: the same for a second array, in its place, where none may be left."""
    none = F.array().cast("array<string>")
    both = {to: expanded(F.col(terms))} | ({others: expanded(F.coalesce(others, none))} if others else {})
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("terms")) for k, v in both.items()])
    x = rows.select(*keys, F.explode(kinds).alias("_k")).select(*keys, F.col("_k.kind").alias("_kind"), F.posexplode("_k.terms").alias("_at", "_term"))
    x = x.withColumn("_term", lexical(F.col("_term"))).where("_term <> ''")
    ordered = lambda k: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("_kind") == k, F.struct("_at", "_term")))), lambda t: t["_term"])).alias(k)
    x = x.groupBy(*keys).agg(*map(ordered, both)).where(F.size(to) > 0)
    return rows.drop(*both).join(grown(x), keys)


def concept_plan(queries: DataFrame, limits: tuple[int, int] | None = None) -> DataFrame:
    """Queries (job, category, query, required, preferred, degree) to concepts: job, category, ord, priority, alternatives, substitutes.

    required and preferred: arrays of skills (canonical, aliases, substitutes); degree: arrays of terms, one for the level and one for the fields.
    Named skills come first (for education the degree's terms), then technical names, compounds and quoted phrases of the query, items of
    its lists without stop words at their ends, and the words that no concept has yet. Concepts with the same alternatives are one. A query
    that asks for nothing adds none. limits: the number of concepts from which no words are added, and the most in all; without them all stay.
    """
    q, of = F.col("query"), ["job", "category"]
    asks, education = _asks(q), F.col("category") == "EDUCATION"
    nobody = F.array().cast("array<string>")
    row = lambda part, i, priority, terms, others: F.struct(F.lit(part).alias("part"), i.alias("pos"), F.lit(priority).alias("priority"), terms.alias("terms"), others.alias("substitutes"))
    rows = lambda part, priority, terms: F.transform(terms, lambda t, i: row(part, i, priority, t, nobody))
    skilled = lambda part, priority, some: F.transform(F.coalesce(F.when(~education, some), none_of), lambda k, i: row(part, i, priority, F.concat(F.array(k["canonical"]), F.coalesce(k["aliases"], nobody)), F.coalesce(k["substitutes"], nobody)))
    single = lambda names: F.transform(names, lambda n: F.array(n))
    none, none_of = F.array().cast("array<array<string>>"), F.array().cast(f"array<{SKILL}>")
    known = F.array_compact(F.array(*[F.when(reduce(or_, [q.rlike(mentioned(n)) for n in g]), F.array(F.lit(g[0]))) for g in GROUPS]))
    named = F.concat(
        rows(0, "required", F.when(education, F.coalesce("degree", none)).otherwise(none)), skilled(0, "required", F.col("required")), skilled(1, "preferred", F.col("preferred")),
        rows(2, "context", F.when(asks, known).otherwise(none)),
        rows(3, "context", F.when(asks, single(F.regexp_extract_all(q, F.lit(rf"(?i)\b({COMPOUNDS})\b")))).otherwise(none)),
        rows(4, "context", F.when(asks, single(F.regexp_extract_all(q, F.lit(r'"([^"\n]{1,120})"')))).otherwise(none)),
        rows(5, "context", F.when(asks & q.rlike("[,;]"), single(F.split(q, r"(?i)[,;]|\b(?:and|or)\b"))).otherwise(none)),
    )
    x = queries.select(*of, F.explode(named).alias("c")).select(*of, "c.*").withColumn("item", lexical(F.element_at("terms", 1)))
    item = F.trim(F.regexp_replace(F.regexp_replace("item", rf"^(?:{_STOP}(?: |$))+", ""), rf"(?:(?:^| ){_STOP})+$", ""))
    x = x.withColumn("terms", F.when(F.col("part") == 5, F.array(item)).otherwise(F.col("terms"))).drop("item")
    x = x.where((F.col("part") != 5) | ((F.col("terms")[0] != "") & (F.size(F.split(F.col("terms")[0], " ")) <= ITEM_WORDS)))
    x = alternatives(x, [*of, "part", "pos"], "terms", "alternatives", "substitutes").drop("terms")
    once = Window.partitionBy(*of, F.array_join("alternatives", "\n")).orderBy("part", "pos")
    x = x.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    covered = x.select(*of, F.explode(F.split(F.array_join(F.concat("alternatives", "substitutes"), " "), " ")).alias("word")).distinct()
    words = queries.where(asks).select(*of, F.posexplode(F.split(lexical(q), " ")).alias("pos", "word")).where(~F.col("word").rlike(rf"^{_STOP}$") & (F.col("word") != ""))
    words = words.groupBy(*of, "word").agg(F.min("pos").alias("pos")).join(grown(covered), [*of, "word"], "left_anti")
    words = words.select(*of, F.lit(6).alias("part"), "pos", F.lit("context").alias("priority"), F.array("word").alias("terms"), nobody.alias("substitutes"))
    x = x.union(alternatives(words, [*of, "part", "pos"], "terms", "alternatives", "substitutes").drop("terms").select(*x.columns))
    x = x.withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumn("ord", F.row_number().over(Window.partitionBy(*of).orderBy("part", "pos")))
    if limits is not None:
        words_to, most = map(F.lit, limits)
        named_n = F.sum((F.col("part") < 6).cast("int")).over(Window.partitionBy(*of))
        most = F.when(F.col("part") < 6, most).otherwise(F.least(most, F.greatest(words_to, named_n + 1)))
        x = x.withColumn("_most", most).where(F.col("ord") <= F.col("_most"))
    return x.select(*of, "ord", "priority", "alternatives", "substitutes")


def target_concepts(plan: DataFrame, targets: DataFrame) -> DataFrame:
    """A plan and, after its concepts, all groups of the category's targets (job, category, target_id, treatment, groups)."""
    of = ["job", "category"]
    t = targets.select(*of, "target_id", "treatment", F.posexplode("groups").alias("no", "terms"))
    t = alternatives(t, [*of, "target_id", "no"], "terms", "alternatives")
    priority = F.when(F.col("treatment") == "preference", "preferred").otherwise("required")
    t = t.select(*of, F.lit(1).alias("after"), F.struct(F.col("target_id"), F.col("no")).alias("place"), priority.alias("priority"), "alternatives")
    p = plan.select(*of, F.lit(0).alias("after"), F.struct(F.lit("").alias("target_id"), F.col("ord").alias("no")).alias("place"), "priority", "alternatives")
    x = p.union(t).withColumn("ord", F.row_number().over(Window.partitionBy(*of).orderBy("after", "place")))
    return x.select(*of, "ord", "priority", "alternatives")


def retrieval_counts(concepts: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """Per query: concepts, dense, sparse and fused hits, those returned, and those of them with a sparse rank. hits: query, dense_rank, sparse_rank, returned."""
    n = concepts.groupBy(query).agg(F.count("*").alias("concepts"))
    h = hits.groupBy(query).agg(
        F.count("dense_rank").alias("dense_hits"), F.count("sparse_rank").alias("sparse_hits"), F.count("*").alias("fused_hits"), F.count_if("returned").alias("returned_hits"),
        F.count_if(F.col("returned") & F.col("sparse_rank").isNotNull()).alias("returned_sparse_hits"),
    )
    return n.join(h, query, "full_outer").fillna(0)


def hybrid(chunks: DataFrame, queries: DataFrame, concepts: list[tuple[str, str, tuple[str, ...]]], key: str, k: int = 10) -> DataFrame:
    """Chunks (key, id, v, lexical) of each key, ranked against its query (key, q) by vectors and by concepts, each to k, fused by reciprocal ranks to 2 k."""
    dense = dense_top(chunks.select(key, "id", "v"), queries, key, k)
    sparse = sparse_top(chunks.select(key, "id", "lexical"), concepts, k, (key,))
    return reciprocal_rank_fusion(dense, sparse, [key], "id").where(F.col("place") <= 2 * k)


def in_scope(chunks: DataFrame, fallback: str | None = None, once: bool = False) -> DataFrame:
    """(doc_id, category, chunk_id) to (doc_id, wanted, place, chunk_id): the chunks in which each category is looked for, place by the order of its sections.

    Where a document has none of them, the chunks of the fallback's category. Once: a chunk of several categories is found once for each wanted,
    where its scope comes first, as by one_hit() with one rank for all its rows. What a document or a chunk has is a set of bits over its rows, so they meet once, before they are made many.
    """
    kinds = list(dict.fromkeys(c for cs in SCOPES.values() for c in cs))
    scope = lambda w, k: F.struct(F.lit(w).alias("wanted"), F.lit(k).alias("place"))
    mine = F.create_map(*[v for c in kinds for v in (F.lit(c), F.array(*[scope(w, cs.index(c)) for w, cs in SCOPES.items() if c in cs]))])[F.col("category")]
    bit = F.coalesce(*[F.when(F.col("category") == c, 1 << k) for k, c in enumerate(kinds)], F.lit(0))
    has = lambda bits, c: F.col(bits).bitwiseAND(1 << kinds.index(c)) != 0
    x = chunks
    if fallback is not None:
        x = x.withColumn("_has", F.bit_or(bit).over(Window.partitionBy("doc_id")))
        other = F.array_compact(F.array(*[F.when(~reduce(or_, [has("_has", c) for c in cs]), scope(w, -1)) for w, cs in SCOPES.items()]))
        x = x.withColumn("_other", F.when((F.col("category") == fallback) & F.col("doc_id").isNotNull(), other))
    if once:
        chunk = Window.partitionBy("doc_id", "chunk_id")
        mine = F.array_compact(F.array(*[F.coalesce(*[F.when(has("_of", c), scope(w, k)) for k, c in enumerate(cs)]) for w, cs in SCOPES.items()]))
        others = [F.max("_other").over(chunk).alias("_other")] if fallback is not None else []
        x = x.select("doc_id", "chunk_id", "category", F.bit_or(bit).over(chunk).alias("_of"), *others).withColumn("_n", F.row_number().over(chunk.orderBy("category"))).where("_n = 1")
    if fallback is not None:
        none = F.array().cast("array<struct<wanted:string,place:int>>")
        mine = F.concat(F.coalesce(mine, none), F.coalesce("_other", none))
    return x.select("doc_id", "chunk_id", F.explode(mine).alias("s")).select("doc_id", "s.wanted", "s.place", "chunk_id")


def one_hit(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Hits (keys, chunk_id, place, rank), each chunk once: where its scope comes first, then its rank."""
    w = Window.partitionBy(*keys, "chunk_id").orderBy("place", "rank")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def retained(hits: DataFrame, coverage: DataFrame, top: int = 2) -> DataFrame:
    """Hits (pair_id, hit, score) that stay: the best by score, then, for each target (pair_id, target, hit, coverage), the hit that covers it best, the first of equals; each once, with the reason it came by."""
    w = Window.partitionBy("pair_id").orderBy(F.desc("score"), "hit")
    ranked = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).select("pair_id", "hit", F.lit("reranked").alias("kept"))
    best = coverage.where("coverage > 0").groupBy("pair_id", "target").agg(F.min_by("hit", F.struct(-F.col("coverage"), F.col("hit"))).alias("hit"))
    extra = best.select("pair_id", "hit").distinct().join(ranked, ["pair_id", "hit"], "left_anti")
    return ranked.union(extra.select("pair_id", "hit", F.lit("target").alias("kept")))


def retrieval_queries(profiles: DataFrame, targets: DataFrame) -> DataFrame:
    """Profiles (job, queries: map of category to query, skills) and targets (job, category, ord, text) to the texts searched for: job, category, texts.

    A category's targets, else its query; a project query that asks for nothing is derived from the required skills, and education always has one.
    """
    skills = F.array_distinct(F.filter(F.transform("skills", F.trim), lambda s: s != ""))
    derived = F.concat(F.lit(PROJECTS), F.when(F.size(skills) > 0, F.concat(F.lit(" with "), F.array_join(skills, ", "))).otherwise(F.lit("")))
    own = lambda c: F.coalesce(F.try_element_at("queries", F.lit(c)), F.lit(""))
    query = {c: F.when(_asks(own(c)), own(c)) for c in CATEGORIES}
    query["PROJECTS"], query["EDUCATION"] = F.coalesce(query["PROJECTS"], derived), F.coalesce(query["EDUCATION"], F.lit(EDUCATION))
    x = profiles.select("job", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), v.alias("query")) for c, v in query.items()])).alias("c")).select("job", "c.*")
    t = targets.groupBy("job", "category").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"])).alias("texts"))
    x = x.join(t, ["job", "category"], "left")
    return x.withColumn("texts", F.coalesce("texts", F.when(F.col("query").isNotNull(), F.array("query")))).where("texts is not null").drop("query")


def resolved_targets(approved: DataFrame, skills: DataFrame, queries: DataFrame, plan: DataFrame) -> DataFrame:
    """All targets of each job: job, target_id, category, kind, treatment, text, origin, groups (arrays of terms), substitutes, importance.

    approved: job, target_id, category, kind, treatment, text, groups, and importance and substitutes if there are any (else 1 and none).
    skills: job, no, name, aliases, substitutes, wanted (required or preferred). queries: job, category, query. plan: their concepts. A
    category with an approved requirement is explicit; explicit experience still gets delivery by each required skill. Of the others,
    skills and experience follow from required skills where there are any, preferred skills from the same (without substitutes); the
    rest from the category's query and its first eight concepts, unless it asks for nothing, or, for experience, for years.
    """
    explicit = approved.where("treatment = 'requirement'").select("job", "category").distinct()
    nobody = F.array().cast("array<string>")
    columns = ["job", "target_id", "category", "kind", "treatment", "text", "origin", "groups", "substitutes", "importance"]
    given = lambda c, otherwise: F.coalesce(F.col(c), otherwise) if c in approved.columns else otherwise
    out = approved.withColumns({"origin": F.lit("approved"), "substitutes": given("substitutes", nobody), "importance": given("importance", F.lit(1)).cast("int")}).select(*columns)
    need, nice = (skills.where(F.col("wanted") == w) for w in ("required", "preferred"))
    has = grown(need.select("job").distinct())
    terms = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", nobody)))

    def derived(rows: DataFrame, prefix: str, category: str, text: Column, treatment: str) -> DataFrame:
        return rows.select(
            "job", F.concat(F.lit(prefix), F.col("no").cast("string")).alias("target_id"), F.lit(category).alias("category"), F.lit(KINDS[category]).alias("kind"), F.lit(treatment).alias("treatment"),
            text.alias("text"), F.lit("derived").alias("origin"), F.array(terms).alias("groups"), (F.coalesce("substitutes", nobody) if treatment == "requirement" else nobody).alias("substitutes"), F.lit(1).alias("importance"),
        )

    name, delivery = F.col("name"), F.concat(F.lit(DELIVERY), "name")
    of = lambda c: grown(explicit.where(F.col("category") == c).select("job"))
    out = out.union(derived(need.join(of("EXPERIENCE"), "job", "left_semi"), "derived_delivery_", "EXPERIENCE", delivery, "requirement"))
    out = out.union(derived(need.join(of("EXPERIENCE"), "job", "left_anti"), "derived_experience_", "EXPERIENCE", delivery, "requirement"))
    out = out.union(derived(need.join(of("SKILLS"), "job", "left_anti"), "derived_skills_", "SKILLS", name, "requirement"))
    out = out.union(derived(nice.join(has, "job", "left_semi").join(of("SKILLS"), "job", "left_anti"), "derived_preferred_", "SKILLS", name, "preference"))
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "alternatives"))), 1, LEGACY_GROUPS), lambda c: c["alternatives"])
    groups = plan.where(~F.array_join("alternatives", " ").isin(*STOP_WORDS)).groupBy("job", "category").agg(first.alias("groups"))
    left = queries.where(_asks(F.col("query"))).join(grown(explicit), ["job", "category"], "left_anti").join(grown(groups), ["job", "category"])
    skilled = left.where(F.col("category").isin("SKILLS", "EXPERIENCE")).join(has, "job", "left_semi").select("job", "category")
    left = left.join(grown(skilled), ["job", "category"], "left_anti").where((F.col("category") != "EXPERIENCE") | ~F.col("query").rlike(r"(?i)\byears?\b"))
    kind = F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv])[F.col("category")]
    legacy = left.select(
        "job", F.concat(F.lit("legacy_"), F.lower("category")).alias("target_id"), "category", kind.alias("kind"), F.lit("requirement").alias("treatment"), F.col("query").alias("text"), F.lit("derived").alias("origin"), "groups",
        nobody.alias("substitutes"), F.lit(1).alias("importance"),
    )
    return out.union(legacy)


def profile_plan(profiles: DataFrame, queries: DataFrame) -> DataFrame:
    """The concepts of all queries (job, category, query) of profiles (job, required, preferred, level, level_aliases, fields, field_aliases), within the fixed limits of profiles."""
    nobody = F.array().cast("array<string>")
    fields = F.concat(F.coalesce("fields", nobody), F.coalesce("field_aliases", nobody))
    level = F.concat(F.array("level"), F.coalesce("level_aliases", nobody))
    degree = F.when(F.col("level") != "NONE", F.when(F.size(F.coalesce("fields", nobody)) > 0, F.array(level, fields)).otherwise(F.array(level)))
    return concept_plan(queries.join(profiles.select("job", "required", "preferred", degree.alias("degree")), "job"), (WORDS, ALL))


def profile_skills(profiles: DataFrame) -> DataFrame:
    """The skills of profiles, one a row: job, no (from 0 among those wanted alike), name, aliases, substitutes, wanted."""
    x = profiles.select("job", F.explode(F.array(*[F.struct(F.lit(w).alias("wanted"), F.coalesce(w, F.array().cast(f"array<{SKILL}>")).alias("skills")) for w in ("required", "preferred")])).alias("s"))
    x = x.select("job", "s.wanted", F.posexplode("s.skills").alias("no", "k"))
    return x.select("job", "no", F.col("k.canonical").alias("name"), "k.aliases", "k.substitutes", "wanted")
