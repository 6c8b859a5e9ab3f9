"""Concept plans, phrase matching and targets as tables: the cases that a user of such a search relies on."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftspark.operators import phrases, planning, retrieval, sections
from siftspark.operators.retrieval import lexical

PROFILE = f"job string, required array<{planning.SKILL}>, preferred array<{planning.SKILL}>, level string, level_aliases array<string>, fields array<string>, field_aliases array<string>"


def skill(name, aliases=(), substitutes=()):
    return (name, list(aliases), list(substitutes))


def profile(job, required=(), preferred=(), level="NONE", fields=(), field_aliases=(), level_aliases=()):
    return (job, list(required), list(preferred), level, list(level_aliases), list(fields), list(field_aliases))


#: job: (profile, category, query, {text: (required, preferred, context)})
CASES = {
    "sharp": (profile("sharp", [skill("C#")]), "SKILLS", "C#", {"C Sharp": (1, 0, 0), "C++": (0, 0, 0), "unrelated text": (0, 0, 0)}),
    "plus": (profile("plus", [skill("C++")]), "SKILLS", "C++", {"CPP": (1, 0, 0), "C#": (0, 0, 0)}),
    "net": (profile("net", [skill(".NET")]), "SKILLS", ".NET", {"dotnet": (1, 0, 0), "internet": (0, 0, 0)}),
    "node": (profile("node", [skill("Node.js")]), "SKILLS", "Node.js", {"NodeJS": (1, 0, 0), "node": (0, 0, 0)}),
    "java": (profile("java", [skill("Java")]), "SKILLS", "Java", {"Java": (1, 0, 0), "JavaScript": (0, 0, 0), "Java Java Java": (1, 0, 0)}),
    "any": (
        profile("any", [skill("Java", substitutes=["C#"]), skill("Spring Boot")], [skill("PostgreSQL", ["Postgres"])]), "SKILLS", "Strong experience required with Java, Spring Boot and databases",
        {"Used C Sharp": (1, 0, 0), "Spring holiday and leather boot": (0, 0, 0), "Spring Boot with Postgres PostgreSQL": (1, 1, 0), "databases": (0, 0, 1), "required experience": (0, 0, 0)},
    ),
    "nothing": (profile("nothing", [skill("Java")]), "EDUCATION", "No explicit requirement", {"Java": (0, 0, 0)}),
    "degree": (profile("degree", [skill("Java")], level="BACHELOR", fields=["Computer Science"]), "EDUCATION", "Bachelor in Computer Science", {"Bachelor in Computer Science": (2, 0, 0), "Java": (0, 0, 0)}),
    "fields": (profile("fields", level="BACHELOR", fields=["Computer Science", "Information Technology"], field_aliases=["CS", "IT"]), "EDUCATION", "No explicit requirement", {"Bachelor in CS and Information Technology": (2, 0, 0)}),
    "list": (profile("list"), "SKILLS", "Required experience with Apache Kafka, Apache Spark or Spring Boot", {"Apache Kafka": (0, 0, 1), "Apache unrelated Kafka": (0, 0, 0), "Spring holiday boot": (0, 0, 0)}),
    "syntax": (profile("syntax", [skill("x'); ! y & z")]), "SKILLS", "", {"a x y z b": (1, 0, 0), "x z y": (0, 0, 0)}),
}


@pytest.fixture(scope="module")
def plans(spark):
    profiles = spark.createDataFrame([c[0] for c in CASES.values()], PROFILE)
    queries = spark.createDataFrame([(j, c[1], c[2]) for j, c in CASES.items()], "job string, category string, query string")
    return planning.profile_plan(profiles, queries).cache()


def test_plans_cover_texts_as_asked(spark, plans):
    rows = [(f"{job}: {text}", text) for job, c in CASES.items() for text in c[3]]
    texts = spark.createDataFrame(rows, "id string, text string").select("id", lexical(F.col("text")).alias("lexical"))
    index = phrases.phrase_index(texts, plans.select(F.explode(F.concat("alternatives", "substitutes")).alias("phrase")))
    got = {(r.job, r.id): (r.required, r.preferred, r.context) for r in phrases.concept_hits(index, plans).collect()}
    for job, c in CASES.items():
        for text, want in c[3].items():
            assert got.get((job, f"{job}: {text}"), (0, 0, 0))[: 3 if sum(want) else 1] == want[: 3 if sum(want) else 1], (job, text)


def test_plan_rows(plans):
    rows = {(r.job, r.ord): r for r in plans.collect()}
    assert rows["any", 1].alternatives == ["java"] and rows["any", 1].substitutes == ["techcsharp"] and rows["any", 1].priority == "required"
    assert rows["any", 3].alternatives == ["techpostgresql"] and ("nothing", 1) not in rows
    assert rows["fields", 2].alternatives == ["computer science", "information technology", "cs", "it"]


def test_no_concept_and_no_group_is_left_out(spark):
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    asked = f"job string, category string, query string, required array<{planning.SKILL}>, preferred array<{planning.SKILL}>, degree array<array<string>>"
    plan = planning.concept_plan(spark.createDataFrame([("j", "SKILLS", " ".join(words), [skill(f"Kiln {w}") for w in words], None, None)], asked))
    targets = spark.createDataFrame([("j", "SKILLS", "t", "preference", [[f"Group {w}"] for w in words])], "job string, category string, target_id string, treatment string, groups array<array<string>>")
    whole = [*(f"kiln {w}" for w in words), *(f"group {w}" for w in words)]
    assert [(r.ord, r.alternatives[0]) for r in planning.target_concepts(plan, targets).orderBy("ord").collect()] == list(enumerate(whole, 1))
    plain = planning.concept_plan(spark.createDataFrame([("j", "SKILLS", " ".join(words), None, None, None)], asked))
    assert [(r.ord, r.alternatives[0]) for r in planning.target_concepts(plain, targets).orderBy("ord").collect()] == list(enumerate([*words, *whole[200:]], 1))
    limited = planning.profile_plan(spark.createDataFrame([profile("j")], PROFILE), spark.createDataFrame([("j", "SKILLS", " ".join(words))], "job string, category string, query string"))
    assert limited.count() == planning.WORDS  # what the SQL of profiles says


@pytest.mark.parametrize("firsts", [5_000, 0])
def test_phrase_index_equals_looking_into_texts(spark, monkeypatch, firsts):
    monkeypatch.setattr(phrases, "FIRSTS", firsts)
    texts = [(1, "a b c a b"), (2, "b"), (3, ""), (4, None), (5, "abc b a"), (6, "a " * 5000 + "z")]
    asked = ["a", "a b", "b c a", "c b", "z", "", "a z", "b a b a"]
    index = phrases.phrase_index(spark.createDataFrame(texts, "id int, lexical string"), spark.createDataFrame([(p,) for p in asked * 2], "phrase string"))
    want = sorted((i, p) for i, t in texts for p in asked if p and t and f" {p} " in f" {t.strip()} ")
    assert sorted((r.id, r.phrase) for r in index.collect()) == want
    assert phrases.phrase_index(spark.createDataFrame(texts, "id int, lexical string"), spark.createDataFrame([], "phrase string")).count() == 0


def test_large_tables_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SENT", 2)
    assert "broadcast" not in phrases.sent(spark.range(3))._jdf.queryExecution().analyzed().toString().lower()
    assert phrases.sent(spark.range(2)).count() == 2


TARGET = "job string, target_id string, category string, kind string, treatment string, text string, groups array<array<string>>, substitutes array<string>, importance int"
PASSAGE = "id int, doc_id int, category string, chunk_no int, passage_no int, passage string"


def assess(spark, targets, passages):
    t = spark.createDataFrame([("j", *x) for x in targets], TARGET).withColumn("origin", F.lit("approved"))
    p = spark.createDataFrame([(n, d, c, 0, n, text) for n, (d, c, text) in enumerate(passages)], PASSAGE).withColumn("lexical", lexical(F.col("passage")))
    pairs = spark.createDataFrame([(d, "j", d) for d in sorted({x[0] for x in passages})], "pair_id int, job string, doc_id int")
    rows = phrases.with_passages(phrases.pair_assessments(pairs, t, phrases.target_coverage(p, t)), p).collect()
    return {(r.pair_id, r.target_id): (r.status, round(r.coverage, 3), r.accepted_substitute, r.n_groups, r.passage) for r in rows}


def test_targets_are_divided_by_groups(spark):
    targets = [
        ("both", "SKILLS", "skill", "requirement", "x", [["Java"], ["Spring Boot", "Quarkus"]], ["Kotlin"], 1),
        ("applied", "EXPERIENCE", "experience", "requirement", "x", [["REST API"]], [], 1),
        ("joined", "SKILLS", "skill", "preference", "x", [["test automation"]], [], 1),
    ]
    got = assess(spark, targets, [
        (1, "SKILLS", "Java"), (1, "PROJECTS", "Java with Quarkus"), (1, "EXPERIENCE", "RESTful APIs"), (2, "SKILLS", "Never used Java"), (2, "SKILLS", "Kotlin, not Java"), (2, "EXPERIENCE", "Kotlin"),
        (2, "EXPERIENCE", "Built REST APIs"), (3, "EDUCATION", "Java and Spring Boot"), (3, "SKILLS", "Test-Automation"), (4, "SKILLS", "testautomation in Java"), (4, "SKILLS", "Built a REST API"),
    ])
    assert got[1, "both"] == ("DIRECT", 1.0, False, 2, "Java with Quarkus") and got[1, "applied"][0] == "MISSING_INFORMATION"
    assert got[2, "both"] == ("PARTIAL", 0.5, True, 0, "Kotlin") and got[2, "applied"] == ("DIRECT", 1.0, False, 1, "Built REST APIs")
    assert got[3, "both"][0] == "MISSING_INFORMATION" and got[3, "joined"][:2] == ("DIRECT", 1.0)
    assert got[4, "joined"][0] == "DIRECT" and got[4, "both"][:2] == ("PARTIAL", 0.5) and got[4, "applied"] == ("MISSING_INFORMATION", 0.0, False, 0, None)


def test_degree_replaces_groups_and_skills_become_targets(spark):
    profiles = spark.createDataFrame([profile("j", [skill("Java", ["JDK"], ["Kotlin"])], [skill("SQL", [], ["NoSQL"])], "BACHELOR", ["Physics"], ["Optics"], ["BSc"])], PROFILE)
    approved = spark.createDataFrame([
        ("j", "e", "EDUCATION", "education", "requirement", "A BSc in physics", [["Physics"], ["Chemistry"]], [], 3), ("j", "f", "EDUCATION", "education", "preference", "Bachelor", [["x"]], [], 1),
        ("j", "g", "EXPERIENCE", "responsibility", "requirement", "Runs it", [["run"]], ["walk"], 2), ("j", "h", "EDUCATION", "education", "requirement", "A doctorate", [["PhD"]], [], 1),
    ], TARGET)
    queries = spark.createDataFrame([("j", "PROJECTS", "graph databases")], "job string, category string, query string")
    out = planning.resolved_targets(approved, planning.profile_skills(profiles), queries, planning.profile_plan(profiles, queries))
    got = {r.target_id: r for r in phrases.with_degrees(out, profiles).collect()}
    assert got["e"].groups == [["Bachelor", "BSc"], ["Physics", "Optics"]] and got["e"].importance == 3
    assert got["f"].groups == [["x"]] and got["h"].groups == [["PhD"]] and got["g"].substitutes == ["walk"]
    assert got["derived_delivery_0"].groups == [["Java", "JDK"]] and got["derived_delivery_0"].substitutes == ["Kotlin"] and got["derived_skills_0"].category == "SKILLS"
    assert got["derived_preferred_0"].substitutes == [] and got["derived_preferred_0"].treatment == "preference" and "derived_experience_0" not in got
    assert [g[0] for g in got["legacy_projects"].groups][-2:] == ["graph", "databases"]


def test_texts_are_cut_and_indexed_once(spark):
    docs = spark.createDataFrame([(1, "Made parts. Led it")], "doc_id int, text string")
    texts = sections.passages(docs).select("doc_id", F.upper("passage").alias("lexical"))
    index = phrases.phrase_index(texts.select(F.col("doc_id").alias("id"), "lexical"), spark.createDataFrame([("LED IT",)], "phrase string"))
    assert [tuple(r) for r in index.collect()] == [(1, "LED IT")]
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2 and "size(filter" not in plan  # one cut of texts, one of words


def test_passages_equal_a_plain_cut(spark):
    odd = ["", " ", None, ";;a; b ;\n c.\n D! E;", "  x.  Y\t\n\n;z \x0b\f;", "a . B", "q.\nR; \n", ";", "no end", "É. É. A", "a\r\nb;  ;  ;c.  D  "]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    got = [tuple(r) for r in sections.passages(docs).orderBy("doc_id", "passage_no").collect()]
    cut = lambda t: [p for x in re.split(r"[\n;]|(?<=[.!?])[ \t\n\r\f\v]+(?=[A-Z])", t) if (p := x.strip(" \t\n\r\f\v"))]
    assert got == [(i, k, p) for i, t in enumerate(odd) if t is not None for k, p in enumerate(cut(t))]


def test_folding_of_every_character_and_of_latin_texts_without_python(spark):
    some = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000] + ["Straße ÀÉ – “Ñ”", "é", "É́"]
    x = spark.createDataFrame([(t,) for t in some], "t string").select("t", retrieval.folded(F.col("t")).alias("f"), retrieval.beyond_latin(F.col("t")).alias("python"))
    rows = x.collect()
    assert [r for r in rows if r.f != unicodedata.normalize("NFKC", r.t).casefold()] == []
    kinds = {r.t: r.python for r in rows}
    assert not kinds["ß"] and not kinds["É"] and not kinds["Straße ÀÉ – “Ñ”"] and kinds["½"] and kinds["é"] and kinds["Ω"]
