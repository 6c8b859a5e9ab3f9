"""Chunks that keep their places, passages held by others, unions of intervals, against plain loops."""

import random
import re
from collections import defaultdict

from siftspark.operators import anchors, intervals, located, sections, support

BLOCKS = "doc_id int, page_number int, block_no int, bbox array<double>, text string, page_number_ string"


def test_blocks_that_are_heading_and_text(spark):
    rows = [
        (1, 1, 0, [0.0, 1.0], "Jane\nWORK EXPERIENCE\nEngineer | A", None),  # text, heading and text in one block
        (1, 1, 1, None, "2019 - 2020 at some place", None),
        (1, 2, 0, [2.0], "Lead of the platform", None),  # a title: the next page begins with a year
        (1, 3, 0, [3.0], "since 2021", None), (1, 3, 1, [4.0], " \n ", None), (1, 3, 2, [5.0], None, None), (1, 3, 3, [6.0], "SKILLS", None), (1, 5, 0, [7.0], "Java and Spark", None),
        (1, 5, 1, [8.0], "EDUCATION:\nBachelor\nSKILLS\nalso Scala\nEducation\nof science", None),
        (2, 1, 0, [], "PROJECTS", None), (2, 1, 1, [], "Tool | one", None), (2, 1, 2, [], "- made | it", None), (2, 1, 3, [], "Tool | two", None), (3, 1, 0, [], None, None),
    ]
    got = [(x.doc_id, x.global_chunk_id, x.section, x.chunk_index, x.text.split("] ", 1)[1], [(p.page_number, p.block_no) for p in x.locations]) for x in located.located_chunks(spark.createDataFrame(rows, BLOCKS)).orderBy("doc_id", "global_chunk_id").collect()]
    assert [(*g[:3], *g[4:]) for g in got] == [
        (1, 0, "EXPERIENCE", "Engineer | A 2019 - 2020 at some place", [(1, 0), (1, 1)]), (1, 1, "EXPERIENCE", "Lead of the platform since 2021", [(2, 0), (3, 0)]),
        (1, 2, "SKILLS", "Java and Spark", [(5, 0)]), (1, 3, "EDUCATION", "Bachelor of science", [(5, 1)]), (1, 4, "SKILLS", "also Scala", [(5, 1)]),
        (2, 0, "PROJECTS", "Tool | one made | it", [(1, 1), (1, 2)]), (2, 1, "PROJECTS", "Tool | two", [(1, 3)]),
    ]
    assert located.located_chunks(spark.createDataFrame([], BLOCKS)).count() == 0


def test_long_entries_repeat_their_header(spark):
    rows = [(1, 1, 0, [1.0], "EXPERIENCE", ""), (1, 1, 1, [2.0], "Engineer " + "x" * 200, ""), (1, 1, 2, [3.0], "y" * 900, "")]
    got = located.located_chunks(spark.createDataFrame(rows, BLOCKS)).orderBy("global_chunk_id").collect()
    header = ("Engineer " + "x" * 200 + " " + "y" * 900)[:160]
    assert len(got) > 2 and all(x.text.startswith(f"[Section: EXPERIENCE] {header}\n") == (x.chunk_index > 0) and x.bbox == [2.0] for x in got)
    assert all(x.char_length == len(x.text) - len("[Section: EXPERIENCE] ") for x in got)


def test_a_title_needs_the_next_page(spark):
    block = lambda page, text: (1, page, 0, None, text, "")
    n = lambda *b: located.entries(spark.createDataFrame(list(b), BLOCKS)).count()
    assert n(block(1, "First thing"), block(2, "Lead"), block(3, "since 2021")) == 2
    assert n(block(1, "First thing"), block(2, "Lead"), block(4, "since 2021")) == 1  # page 3 has no blocks


def test_document_chunks_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "only text here"), (5, "SKILLS\n"), (6, "intro text\nSKILLS\nJava and Spark\nEDUCATION\nBachelor\nSkills:\nScala too")]
    got = [(x.doc_id, x.global_chunk_id, x.section, x.category, x.text) for x in sections.document_chunks(spark.createDataFrame(rows, "doc_id int, text string")).orderBy("doc_id", "global_chunk_id").collect()]
    assert got == [
        (4, 0, "EXPERIENCE", "EXPERIENCE", "[Section: EXPERIENCE] only text here"), (6, 0, "SUMMARY", "EXPERIENCE", "[Section: SUMMARY] intro text"),
        (6, 1, "SKILLS", "SKILLS", "[Section: SKILLS] Java and Spark Scala too"), (6, 2, "EDUCATION", "EDUCATION", "[Section: EDUCATION] Bachelor"),
    ]


def test_sentences_held_at_word_boundaries(spark):
    r = random.Random(3)
    words = ["a", "b", "ab", "Spark", "C++", "C", "é", "éa", "x.y", "--", "\\E", "$1", "[Section: SKILLS]", "a_b"]
    text = lambda n: r.choice([" ", "  ", "\t"]).join(r.choice(words) for _ in range(r.randrange(n)))
    kinds = ["SKILLS", "EXPERIENCE", None]
    full = [(r.randrange(4), r.choice(kinds), r.choice(kinds), text(9)) for _ in range(120)] + [(1, "SKILLS", "SKILLS", None)]
    rows = [(r.randrange(4), k, c, r.choice(kinds), text(4)) for k in range(150) for c in r.sample(kinds, r.randrange(1, 3))] + [(1, 900, "SKILLS", "SKILLS", None), (1, 901, "SKILLS", "SKILLS", "  ")]
    norm = lambda t: " ".join(re.sub(r"^\s*\[Section: [^]]+\]\s*", "", t or "").split())
    want = defaultdict(lambda: True)
    for pair, k, c, s, t in rows:
        found = bool(norm(t)) and any(f[:3] == (pair, c, s) and re.search(r"(?<!\w)" + re.escape(norm(t)) + r"(?!\w)", norm(f[3])) for f in full)
        want[pair, k] = want[pair, k] and found
    got = anchors.kept_sentences(spark.createDataFrame(rows, "pair_id int, row int, category string, source_category string, text string"), spark.createDataFrame(full, "pair_id int, category string, source_category string, text string"))
    got = {(x.pair_id, x.row): not x.kept for x in got.collect()}
    assert got == dict(want) and 20 < sum(got.values()) < len(got) - 20


def test_not_contained_keeps_rows_and_columns(spark):
    rows = [(1, 1, "Built  APIs", 7), (1, 1, "Built  APIs", 7), (1, 2, "we built apis today", 8), (1, 3, "uilt apis", 9), (1, 3, None, 9), (1, 3, " ", 9), (None, 4, "z", 1), (None, 5, "z z", 1)]
    x = spark.createDataFrame(rows, "conv int, turn int, text string, word int")
    got = sorted((repr(v.conv), v.turn, repr(v.text)) for v in support.not_contained(x, x, ["conv"], "turn").collect())
    assert got == [("1", 2, "'we built apis today'"), ("1", 3, "' '"), ("1", 3, "'uilt apis'"), ("1", 3, "None"), ("None", 5, "'z z'")]


def union(spans):
    covered, islands, reach = 0, 0, None
    for a, b in sorted(spans):
        if reach is None or a > reach:
            covered, islands, reach = covered + b - a, islands + 1, b
        elif b > reach:
            covered, reach = covered + b - reach, b
    return covered, islands


def test_union_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(intervals, "HELD", 500)
    r = random.Random(5)
    rows = [(0 if r.random() < 0.7 else r.randrange(1, 9), a := r.randrange(200_000), a + r.choice([0, 1, 5, 60])) for _ in range(20_000)] + [(0, -5, 300), (3, 0, 200_050), (4, 7, 7), (4, 7, 7)]
    bad = [(None, 1, 2), (5, None, 3), (5, 4, None), (77, 9, 8)]
    x = spark.createDataFrame(rows + bad, "who int, a long, b long").repartition(7)
    want = defaultdict(list)
    for k, a, b in rows:
        want[k].append((a, b))
    got = {v.who: (v.covered, v.islands) for v in intervals.interval_union(x, "who", "a", "b").collect()}
    assert got == {k: union(v) for k, v in want.items()} and got[0][1] > 1000
    assert intervals.interval_union(x.limit(0), "who", "a", "b").count() == 0
