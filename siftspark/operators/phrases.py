"""Phrases of profiles in texts, by equality: an index of the asked phrases that each text holds, and what follows from it.

Profiles ask for phrases: concepts of queries, terms of targets. Texts are cut into runs of words of
the lengths asked for, once for all profiles, and meet the phrases in one equality join. Everything
after that is a join or a grouped sum over the index, so profiles stay tables from end to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .coverage import APPLIED
from .retrieval import PRIORITIES, folded, lexical
from .skills import NEGATIONS, SCOPES, VERBS, acts, expanded, negated

#: Rows of a profile's table that are sent to all tasks; a larger one is joined by a shuffle.
SENT = 200_000
#: A term of more parts than this is looked for with all its parts apart or all joined.
PARTS = 6
#: First words of phrases that a plan holds as a set; with more of them all runs of words are made.
FIRSTS = 5_000


def sent(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Marks a table for broadcast if it has at most SENT rows."""
    most = SENT if most is None else most
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def phrase_index(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, lexical) and asked phrases (phrase) to (id, phrase), each once: the phrases that a text holds as whole words.

    A text's runs of n words are made for the lengths n that are asked for, where a phrase of that
    length begins with the run's first word (unless the phrases have over FIRSTS first words), each
    run once a text. Null and empty texts and phrases have no row; rows with one id count as one text.
    """
    asked = phrases.select("phrase").where("phrase <> ''").distinct()
    parts = F.split("phrase", " ")
    found = asked.select(F.size(parts).alias("n"), parts[0].alias("first")).distinct().limit(FIRSTS + 1).collect()
    gated = len(found) <= FIRSTS
    lengths = sorted({r.n for r in (found if gated else asked.select(F.size(parts).alias("n")).distinct().collect())})
    if not lengths:
        return texts.select("id", F.lit("").alias("phrase")).limit(0)
    words = F.col("_words")

    def runs(n: int) -> Column:
        begins = F.sequence(F.lit(1), F.size(words) - n + 1)
        if gated:
            firsts = sorted(r.first for r in found if r.n == n)
            if n == 1:
                return F.filter(words, lambda w: w.isin(firsts))
            begins = F.filter(begins, lambda i: F.element_at(words, i).isin(firsts))
        made = words if n == 1 else F.transform(begins, lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))

    # no filter on the lexical form and no plain explode: Spark would make the form and the runs once more for either
    x = texts.select("id", F.split("lexical", " ").alias("_words"))
    x = x.select("id", F.explode_outer(F.array_distinct(F.concat(*map(runs, lengths)))).alias("phrase")).where("phrase is not null")
    return x.join(sent(asked), "phrase").select("id", "phrase")


def concept_hits(index: DataFrame, concepts: DataFrame) -> DataFrame:
    """An index and concepts (job, category, ord, priority, alternatives, substitutes) to job, category, id and how many required, preferred and context concepts the text holds.

    A concept counts once, however many of its phrases occur; a substitute counts as the concept does.
    """
    c = concepts.select("job", "category", "ord", "priority", F.explode(F.array_distinct(F.concat("alternatives", "substitutes"))).alias("phrase"))
    x = index.join(sent(c), "phrase")
    n = lambda p: F.size(F.collect_set(F.when(F.col("priority") == p, F.col("ord")))).alias(p)
    return x.groupBy("job", "category", "id").agg(*map(n, PRIORITIES))


def concept_top(hits: DataFrame, k: int = 10, keys: tuple[str, ...] = ("job", "category")) -> DataFrame:
    """The k best texts of each key by required, preferred and context concepts, then id."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(p) for p in PRIORITIES], "id")
    return hits.withColumn("sparse_rank", F.row_number().over(w)).where(F.col("sparse_rank") <= k)


def term_phrases(rows: DataFrame, keys: list[str], term: str) -> DataFrame:
    """(keys, term) to (keys, phrase), each once: what a text's lexical form holds where it names the term.

    All spellings of the term in lexical form, and their parts joined: "test automation" is also
    found as "testautomation". A term has at most 32 such phrases for each spelling.
    """
    x = rows.select(*keys, F.explode(expanded(F.array(term))).alias("_way")).distinct()
    x = x.select(*keys, lexical(F.col("_way")).alias("_whole"), folded(F.trim("_way")).alias("_way"))
    parts = F.filter(F.transform(F.split("_way", r"[\s._-]+"), lambda p: F.array_join(F.regexp_extract_all(p, F.lit(r"(?U)([^\W_]+)")), " ")), lambda p: p != "")
    x = x.withColumn("_parts", parts)
    few = F.aggregate(
        F.slice("_parts", 2, PARTS), F.array(F.element_at("_parts", 1)), lambda some, p: F.flatten(F.transform(some, lambda s: F.array(F.concat(s, F.lit(" "), p), F.concat(s, p))))
    )
    all_ways = F.when(F.size("_parts") < 2, F.array().cast("array<string>")).when(F.size("_parts") <= PARTS, few).otherwise(F.array(F.array_join("_parts", " "), F.array_join("_parts", "")))
    return x.select(*keys, F.explode(F.array_union(F.array("_whole"), all_ways)).alias("phrase")).where("phrase <> ''").distinct()


def group_terms(targets: DataFrame) -> DataFrame:
    """Targets (job, target_id, groups, substitutes) to job, target_id, group (-1: substitutes), phrase."""
    groups = F.concat(F.transform("groups", lambda g, i: F.struct(i.alias("group"), g.alias("terms"))), F.array(F.struct(F.lit(-1).alias("group"), F.coalesce("substitutes", F.array().cast("array<string>")).alias("terms"))))
    x = targets.select("job", "target_id", F.explode(groups).alias("g")).select("job", "target_id", "g.group", F.explode("g.terms").alias("term"))
    return term_phrases(x, ["job", "target_id", "group"], "term")


def target_coverage(passages: DataFrame, targets: DataFrame, own: str | None = None) -> DataFrame:
    """The best passage of each document for each target that it covers at all.

    passages: id (unique), doc_id, category, chunk_no, passage_no, passage, lexical. targets: job,
    target_id, category, kind, groups (arrays of terms; all groups are asked for, any term of one
    will do), substitutes. A passage covers the share of groups of which it names a term: the groups
    found in the index over those asked for, a relational division. Where it names none but a
    substitute it covers a half. Passages with a negation don't count, nor those outside the
    sections of the target's category, nor, for applied kinds, those without a verb of action in a
    section of experience or projects. The first of the best wins. own: the passages' job, where a
    document is held against one job's targets alone.
    Out: job, doc_id, target_id, coverage, accepted_substitute, n_groups (covered), passage_id.
    """
    text, words = F.col("passage"), F.split("lexical", " ")
    holds = lambda some: F.arrays_overlap(words, F.array(*map(F.lit, some)))  # noqa: E731  (cheaper than the pattern, and true wherever the pattern is found)
    p = passages.withColumn("_acts", F.col("category").isin("EXPERIENCE", "PROJECTS") & holds(VERBS) & acts(text)).withColumn("lexical", F.when(~(holds(NEGATIONS) & negated(text)), F.col("lexical")))
    # all that is asked of a passage later travels in the index, so that texts are read once and never shuffled
    place = [F.col("id"), F.col("doc_id"), F.col("category"), F.col("chunk_no"), F.col("passage_no"), F.col("_acts")]
    terms = group_terms(targets)
    index = phrase_index(p.select(F.struct(*place, *([] if own is None else [F.col(own).alias("job")])).alias("id"), "lexical"), terms)
    found = index.select("id.*", "phrase").join(sent(terms), ["phrase"] if own is None else ["job", "phrase"])
    found = found.groupBy("id", "job", "target_id").agg(
        F.size(F.collect_set(F.when(F.col("group") >= 0, F.col("group")))).alias("n_groups"), *[F.first(c).alias(c) for c in ("doc_id", "category", "chunk_no", "passage_no", "_acts")]
    )
    t = targets.select("job", "target_id", F.col("category").alias("_wanted"), F.col("kind").isin(*APPLIED).alias("_applied"), F.size("groups").alias("_asked"))
    x = found.join(sent(t), ["job", "target_id"])
    scopes = F.create_map(*[v for c, some in SCOPES.items() for v in (F.lit(c), F.array(*map(F.lit, some)))])
    x = x.where(F.array_contains(scopes[F.col("_wanted")], F.col("category")) & (~F.col("_applied") | F.col("_acts")))
    cover = F.when(F.col("n_groups") == 0, 0.5).otherwise(F.col("n_groups") / F.col("_asked"))
    x = x.withColumns({"coverage": cover, "accepted_substitute": F.col("n_groups") == 0})
    best = F.min_by(F.struct("coverage", "accepted_substitute", "n_groups", F.col("id").alias("passage_id")), F.struct(-F.col("coverage"), F.col("chunk_no"), F.col("passage_no")))
    return x.groupBy("job", "doc_id", "target_id").agg(best.alias("b")).select("job", "doc_id", "target_id", "b.*")


def with_passages(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """Adds the text of the passage that passage_id names, where there is one."""
    return rows.join(passages.select(F.col("id").alias("passage_id"), "passage"), "passage_id", "left").drop("passage_id")


def pair_assessments(pairs: DataFrame, targets: DataFrame, covered: DataFrame) -> DataFrame:
    """Pairs (pair_id, job, doc_id), all with a row for each target of their job: the target's columns, coverage (0: nothing found), status, accepted_substitute, n_groups, passage_id."""
    x = pairs.select("pair_id", "job", "doc_id").join(sent(targets.select("job", "target_id", "category", "kind", "treatment", "importance", "origin")), "job")
    x = x.join(covered, ["job", "doc_id", "target_id"], "left")
    some = F.col("coverage").isNotNull()
    status = F.when(~some, "MISSING_INFORMATION").when((F.col("coverage") == 1) & ~F.col("accepted_substitute"), "DIRECT").otherwise("PARTIAL")
    return x.withColumn("status", status).fillna({"coverage": 0.0, "accepted_substitute": False, "n_groups": 0})


def with_degrees(targets: DataFrame, degrees: DataFrame) -> DataFrame:
    """Targets whose education requirement names the profile's degree ask for the degree's level and fields in place of their own groups.

    degrees: job, level, level_aliases, fields, field_aliases (level NONE or null: no degree). A profile has one row at most.
    """
    empty = F.array().cast("array<string>")
    d = degrees.where("level <> 'NONE'").select(
        "job", F.array_distinct(F.concat(F.array(F.initcap("level")), F.coalesce("level_aliases", empty))).alias("_level"),
        F.array_distinct(F.concat(F.coalesce("fields", empty), F.coalesce("field_aliases", empty))).alias("_fields"),
    )
    wanted = targets.where("kind = 'education' and treatment = 'requirement'").select("job", "target_id", lexical(F.col("text")).alias("lexical"))
    named = wanted.select(F.struct("job", "target_id").alias("id"), "lexical")
    ways = term_phrases(d.select("job", F.explode("_level").alias("term")), ["job"], "term")
    hits = phrase_index(named, ways).join(ways.withColumnRenamed("job", "_of"), "phrase").where("id.job = _of")
    hits = hits.select("id.job", "id.target_id").distinct().withColumn("_hit", F.lit(True))
    x = targets.join(hits, ["job", "target_id"], "left").join(d, "job", "left")
    own = F.when(F.size("_fields") > 0, F.array("_level", "_fields")).otherwise(F.array("_level"))
    return x.withColumn("groups", F.when(F.col("_hit"), own).otherwise(F.col("groups"))).select(*targets.columns)
