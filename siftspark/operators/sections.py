"""Sections, chunks and passages of texts, row by row: nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings of each section (a space stands for any white space), and the category of each section.
HEADINGS = {
    "SUMMARY": [
        "PROFESSIONAL SUMMARY", "EXECUTIVE SUMMARY", "SUMMARY OF QUALIFICATIONS", "SUMMARY", "PROFILE", "PERSONAL PROFILE", "ABOUT ME", "OBJECTIVE", "OVERVIEW",
    ],
    "EXPERIENCE": [
        "WORK EXPERIENCE", "PROFESSIONAL EXPERIENCE", "RELEVANT EXPERIENCE", "EMPLOYMENT HISTORY", "WORK HISTORY", "CAREER HISTORY", "EXPERIENCE",
    ],
    "SKILLS": ["TECHNICAL SKILLS", "CORE COMPETENCIES", "KEY COMPETENCIES", "TECHNOLOGIES", "TECHNICAL EXPERTISE", "TECH STACK", "SKILLS"],
    "PROJECTS": [
        "KEY PROJECTS", "MAJOR PROJECTS", "PERSONAL PROJECTS", "ACADEMIC PROJECTS", "SELECTED PROJECTS", "NOTABLE PROJECTS", "RELEVANT PROJECTS",
        "TECHNICAL PROJECTS", "PROFESSIONAL PROJECTS", "RESEARCH PROJECTS", "PROJECT EXPERIENCE", "PROJECT HIGHLIGHTS", "PROJECT PORTFOLIO", "PROJECTS",
    ],
    "EDUCATION": ["ACADEMIC QUALIFICATIONS", "ACADEMIC BACKGROUND", "EDUCATIONAL BACKGROUND", "QUALIFICATIONS", "EDUCATION"],
    "CERTIFICATIONS": [r"LICENSES\s*(?:&|AND)\s*CERTIFICATIONS", "PROFESSIONAL CERTIFICATIONS", "CERTIFICATIONS", "LICENSES", "COURSES"],
}
CATEGORY = {"SUMMARY": "EXPERIENCE", "EXPERIENCE": "EXPERIENCE", "SKILLS": "SKILLS", "PROJECTS": "PROJECTS", "EDUCATION": "EDUCATION", "CERTIFICATIONS": "EDUCATION"}
#: Least and most characters of a chunk, with its section's prefix in the latter.
LEAST, MOST = 150, 600
#: What parts blocks, and what parts passages, with the blanks around it.
BLOCK_ENDS, PASSAGE_ENDS = r"\n\s*[-•*]\s*|\n\n+|\n(?=\d+\.\s+)", r"(?<!\s)\s*[\n;][\s;]*|(?<=[.!?])\s+(?=[A-Z])"
BLANK = " \t\n\r\f\v"


def heading_pattern(section: str | None = None) -> str:
    known = HEADINGS[section] if section else [h for hs in HEADINGS.values() for h in hs]
    return "|".join(h.replace(" ", r"\s+") for h in known)


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, section, content: one row for each section with content, repeated headings joined by a blank line.

    Text before the first heading is a SUMMARY, text without headings one EXPERIENCE. Null and blank texts have no rows.
    The characters 1 and 2 mark headings on the way and are left out of texts.
    """
    marked = F.regexp_replace(F.translate("text", "\x01\x02", ""), rf"(?imd)^[#*=\-\s]*({heading_pattern()})[:\s\-*=#]*$", "\x01$1\x02")
    parts = F.split(marked, "\x01")
    named = F.lit("EXPERIENCE")
    for name in reversed(HEADINGS):
        named = F.when(F.col("h").rlike(f"(?i)^(?:{heading_pattern(name)})$"), name).otherwise(named)
    x = docs.select("doc_id", F.posexplode(parts).alias("at", "part"), F.size(parts).alias("n"))
    x = x.withColumn("h", _strip(F.substring_index("part", "\x02", 1)))
    name = F.when(F.col("at") > 0, named).when(F.col("n") > 1, "SUMMARY").otherwise("EXPERIENCE")
    body = F.when(F.col("at") > 0, F.substring_index("part", "\x02", -1)).otherwise(F.col("part"))
    x = x.select("doc_id", "at", name.alias("section"), _strip(body).alias("content")).where("content <> ''")
    x = x.groupBy("doc_id", "section").agg(F.sort_array(F.collect_list(F.struct("at", "content"))).alias("c"))
    return x.select("doc_id", "section", F.array_join(F.col("c.content"), "\n\n").alias("content"))


def blocks(content: Column) -> Column:
    """Blocks between bullets, blank lines and numbered items, those of over five characters."""
    raw = F.split(content, BLOCK_ENDS)
    return F.filter(F.transform(raw, _strip), lambda b: F.length(b) > 5)


def packed(section: Column, content: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The bodies of the chunks of a section's content, in order; see chunks()."""
    cap = F.lit(most) - F.length(section) - len("[Section: ] ")
    rule = F.concat(F.lit(r"(?s)\S.{0,"), (cap - 1).cast("string"), F.lit(r"}(?= |\z)|\S.{"), (cap - 1).cast("string"), F.lit("}"))
    cut = F.flatten(F.transform(blocks(content), lambda b: F.when(F.length(b) <= cap, F.array(b)).otherwise(F.regexp_extract_all(b, rule, F.lit(0)))))
    pieces = F.filter(F.transform(cut, _strip), lambda p: p != "")

    def step(acc: Column, piece: Column) -> Column:
        joined = F.when(acc["pending"] == "", piece).otherwise(F.concat(acc["pending"], F.lit(" "), piece))
        over, closed = F.length(joined) > cap, F.length(joined) >= least
        out = F.when(over, F.array_append(acc["out"], acc["pending"])).when(closed, F.array_append(acc["out"], joined)).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(over, piece).when(closed, "").otherwise(joined).alias("pending"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("pending"))
    return F.aggregate(pieces, start, step, lambda a: F.when(a["pending"] == "", a["out"]).otherwise(F.array_append(a["out"], a["pending"])))


def category(section: Column) -> Column:
    """The category of a section; null for a name that is none."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in CATEGORY.items() for v in kv]), section)


def chunks(parsed: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, section, content) to its chunks: section, category, chunk_index, text, char_length.

    Blocks over a section's capacity are cut at the last space within it, else at the capacity; pieces are
    then joined greedily while they fit, and a chunk closes once it has the least length.
    """
    x = parsed.select("doc_id", "section", F.posexplode(packed(F.col("section"), F.col("content"), least, most)).alias("chunk_index", "body"))
    text = F.concat(F.lit("[Section: "), "section", F.lit("] "), "body")
    return x.select("doc_id", "section", category(F.col("section")).alias("category"), "chunk_index", text.alias("text"), F.length("body").alias("char_length"))


def in_order(text: Column) -> Column:
    """array<struct<section, content>> of a text, by each section's first place: what sections() gives as rows, here without a shuffle. Blank texts have none."""
    parts = F.split(F.regexp_replace(F.translate(text, "\x01\x02", ""), rf"(?imd)^[#*=\-\s]*({heading_pattern()})[:\s\-*=#]*$", "\x01$1\x02"), "\x01")
    one = F.array(F.struct(F.lit("EXPERIENCE").alias("section"), _strip(text).alias("content")))

    def part(p: Column, i: Column) -> Column:
        name = F.when(i == 0, "SUMMARY").otherwise(section_of(_strip(F.substring_index(p, "\x02", 1))))
        return F.struct(name.alias("section"), _strip(F.substring_index(p, "\x02", -1)).alias("content"))

    def merged(ps: Column) -> Column:
        rows = F.filter(F.when(F.size(ps) > 1, F.transform(ps, part)).otherwise(one), lambda r: r["content"] != "")
        same = lambda n: F.array_join(F.transform(F.filter(rows, lambda r: r["section"] == n), lambda r: r["content"]), "\n\n")
        return F.transform(F.array_distinct(F.transform(rows, lambda r: r["section"])), lambda n: F.struct(n.alias("section"), same(n).alias("content")))

    return F.get(F.transform(F.array(parts), merged), F.lit(0))


def section_of(heading: Column) -> Column:
    """The section that a heading's words open; EXPERIENCE for others."""
    named = F.lit("EXPERIENCE")
    for name in reversed(HEADINGS):
        named = F.when(heading.rlike(f"(?i)^(?:{heading_pattern(name)})$"), name).otherwise(named)
    return named


def document_chunks(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, text) to the chunks of its sections in order: global_chunk_id from 0 in the document, section, category, chunk_index, text, char_length. Nothing shuffles."""
    each = lambda s: F.transform(packed(s["section"], s["content"], least, most), lambda b, k: F.struct(s["section"].alias("section"), k.alias("chunk_index"), b.alias("body")))
    x = docs.select("doc_id", in_order(F.col("text")).alias("_sections"))
    x = x.select("doc_id", F.posexplode(F.flatten(F.transform("_sections", each))).alias("global_chunk_id", "c")).select("doc_id", "global_chunk_id", "c.*")
    text = F.concat(F.lit("[Section: "), "section", F.lit("] "), "body")
    return x.select("doc_id", "global_chunk_id", "section", category(F.col("section")).alias("category"), "chunk_index", text.alias("text"), F.length("body").alias("char_length"))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to its passages with text: cut at line ends, semicolons, and sentence ends before a capital."""
    cut = F.filter(F.split(_strip(F.col("text")), PASSAGE_ENDS), lambda p: p != "")
    # outer, since a plain explode would cut each text once more, to look for empty ones
    return docs.select("doc_id", F.posexplode_outer(cut).alias("passage_no", "passage")).where("passage is not null")
