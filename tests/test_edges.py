"""Edges of text operators: nulls, empty texts, negation, ties, ambiguous lines."""

from pyspark.sql import functions as F

from siftspark.operators import checks, history, pages, sections, skills, support


def test_negation_stays_in_its_clause(spark):
    rows = [(1, "Not only Java but Go."), (2, "No Java here."), (3, "No Go. Java daily."), (4, None), (5, ""), (6, "Javascript")]
    x = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", skills.skill_check(skills.evidence(F.col("text"), "Java")).alias("code"))
    got = {r.doc_id: r.code.removeprefix("REQUIRED_SKILL_") for r in x.collect()}
    assert got == {1: "FOUND", 2: "NEGATED", 3: "FOUND", 4: "NOT_DOCUMENTED", 5: "NOT_DOCUMENTED", 6: "NOT_DOCUMENTED"}


def test_degrees_outside_their_section_need_an_anchor(spark):
    rows = [(1, "EDUCATION\nMaster and Bachelor of Science"), (2, "Scrum Master at a school"), (3, "see me be\nBachelor, Some University"), (4, ""), (5, "Bachelor of tea")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.degree, r.ambiguous, r.scoped) for r in history.degree_entries(docs, sections.sections(docs)).collect()}
    assert got == {(1, "MASTER", True, True), (1, "BACHELOR", True, True), (3, "BACHELOR", False, False)}


def test_reading_order_of_columns_around_a_wide_block(spark):
    rows = [(1, 1, 1, 0, 300, 10, 400, 20, "right"), (1, 1, 2, 0, 0, 50, 400, 60, "wide"), (1, 1, 3, 0, 0, 10, 100, 20, "left"), (1, 1, 4, 1, 0, 0, 9, 9, "image"), (1, 1, 5, 0, 0, 50, 90, 60, "below"), (1, 1, 6, 0, 0, 0, 9, 9, None)]
    x = spark.createDataFrame(rows, "doc_id int, page_number int, block_no int, block_type int, x0 int, y0 int, x1 int, y1 int, text string")
    assert [r.text for r in pages.reading_order(x).orderBy("place").collect()] == ["left", "right", "wide", "below"]


def test_claims_quotes_and_conflicts_with_nulls(spark):
    x = spark.createDataFrame([(1, None), (2, ""), (3, "Total experience: 2 years")], "id long, text string").select("id", history.claimed_years(F.col("text")).alias("c"), checks.quoted(F.col("text"), F.lit("TOTAL  experience")).alias("q"))
    assert {r.id: (r.c.years, r.q) for r in x.collect()} == {1: (None, False), 2: (None, False), 3: (2.0, True)}
    r = spark.createDataFrame([("a", "1"), ("a", None), ("b", "1"), ("b", "2"), ("c", None)], "key string, value string")
    assert {(z.key, z.value, z.conflict) for z in checks.merged_rules(r, ["key"], "value").collect()} == {("a", "1", False), ("b", None, True), ("c", None, False)}
    j = spark.createDataFrame([(1, None), (2, ""), (3, '{"k": 1.5}')], "id long, raw string").select("id", support.judged(F.col("raw"), "k double", "k").alias("j"))
    assert {z.id: z.j.status for z in j.collect()} == {1: "EVALUATION_FAILED", 2: "EVALUATION_FAILED", 3: "PARSED"}
