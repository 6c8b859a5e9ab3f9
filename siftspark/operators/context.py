"""Dated histories, excerpts, context windows and prompts: row by row, or by pair."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.functions.text import escape_xml

from .checks import squeezed
from .manifests import LETTERS
from .sections import BLANK, BLOCK_ENDS, HEADINGS, LEAST, MOST, chunks, heading_pattern

#: How the ends of a range of months are written, what joins them, months, words for today, and a line that names a role.
END = r"(?:[A-Za-z]+\.?\s+\d{4}|\d{1,2}[/.-]\d{4}|\d{4}[/.-]\d{1,2}|\d{4}|Present|Current|Now)"
RANGE = rf"(?i)({END})\s*(?:[-–—]|\bto\b)\s*({END})"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
TODAY = ("present", "current", "now")
ROLE = r"(?m)^([^\n|]+\|[^\n]+)$"
#: Words that limit a claim.
LIMITS = """
no not never without lack lacks lacking limited basic beginner introductory familiarity exposure assisted helped supported supervised supervision academic prototype prototyping
course coursework tutorial learning studying training aspiring planned planning intended only partly partially
""".split()


def month_index(text: Column, current: int) -> Column:
    """Months since year 0 of one end of a range; null where it gives no month, or none up to the current year."""
    t = F.lower(F.trim(text))
    n = lambda k: F.get(F.split(t, r"[/.-]"), F.lit(k)).try_cast("int")
    word = F.array_position(F.array(*map(F.lit, MONTHS)), F.left(t, F.lit(3))).cast("int")
    year = F.when(t.rlike("^[a-z]"), F.regexp_extract(t, r"(\d{4})$", 1).try_cast("int")).when(n(0) >= 1900, n(0)).otherwise(n(1))
    month = F.when(t.rlike("^[a-z]"), word).when(n(0) >= 1900, n(1)).otherwise(n(0))
    good = month.between(1, 12) & year.between(1900, current // 12)
    return F.when(t.isin(*TODAY), F.lit(current)).when(~t.rlike(r"^\d{4}$") & good, year * 12 + month - 1)


def dated_history(parsed: DataFrame, as_of: tuple[int, int]) -> DataFrame:
    """Sections (doc_id, section, content) to doc_id, months, islands of the union of the ranges that the experience section names.

    No row where the section has no range, where one of its ends gives no month or ends before it
    starts or after as_of (year, month), or where a role ("title | employer") has no range before the next one.
    """
    current = as_of[0] * 12 + as_of[1] - 1
    x = parsed.where("section = 'EXPERIENCE'").withColumn("found", F.regexp_extract_all("content", F.lit(RANGE), F.lit(0)))
    roles = F.slice(F.split(F.regexp_replace("content", ROLE, "\x01$1"), "\x01"), F.lit(2), F.lit(1 << 30))
    ends = lambda m: F.struct(month_index(F.regexp_extract(m, RANGE, 1), current).alias("a"), month_index(F.regexp_extract(m, RANGE, 2), current).alias("b"))
    x = x.withColumn("spans", F.array_sort(F.transform("found", ends)))
    good = F.forall("spans", lambda s: s["a"].isNotNull() & s["b"].isNotNull() & (s["a"] <= s["b"]) & (s["b"] <= current))
    today = F.exists("found", lambda m: F.lower(F.regexp_extract(m, RANGE, 1)).isin(*TODAY))
    x = x.where((F.size("found") > 0) & F.coalesce(good, F.lit(False)) & ~today & F.forall(roles, lambda r: r.rlike(RANGE)))

    def step(acc: Column, s: Column) -> Column:
        new = s["a"] > acc["upto"]
        return F.struct(
            (acc["months"] + F.when(new, s["b"] - s["a"]).otherwise(F.greatest(s["b"] - acc["upto"], F.lit(0)))).cast("long").alias("months"), (acc["islands"] + new.cast("int")).cast("int").alias("islands"),
            F.greatest(acc["upto"], s["b"]).cast("int").alias("upto"),
        )

    start = F.struct(F.lit(0).cast("long").alias("months"), F.lit(0).alias("islands"), F.lit(-1).alias("upto"))
    return x.select("doc_id", F.aggregate("spans", start, step).alias("u")).select("doc_id", "u.months", "u.islands")


def is_excerpt(claim: Column, source: Column) -> Column:
    """Whether a claim stands in a source as whole words, with all limiting words of each sentence that it touches; white space and case apart."""
    c, s = squeezed(claim), squeezed(source)
    limits = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(rf"\b({'|'.join(LIMITS)})\b")))
    parts = F.split(s, r"(?<=[.!?])\s")
    at = F.transform(parts, lambda p, i: F.struct((F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, q: n + F.length(q) + 1) + 1).alias("a"), p.alias("text")))
    word = lambda p: F.substr(s, p, F.lit(1)).rlike(r"(?U)\w")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda p: (F.substr(s, p, F.length(c)) == c) & ~((p > 1) & word(p - 1)) & ~word(p + F.length(c)))

    def kept(p: Column, sentence: Column) -> Column:
        a, z = F.greatest(sentence["a"], p), F.least(sentence["a"] + F.length(sentence["text"]), p + F.length(c))
        return (a >= z) | (F.size(F.array_except(limits(sentence["text"]), limits(F.substr(s, a, z - a)))) == 0)

    return (F.length(c) > 0) & c.rlike(r"(?U)\w") & ((c == s) | F.exists(places, lambda p: F.forall(at, lambda x: kept(p, x))))


def windows(docs: DataFrame, most: int = 3000, least: int = 1500) -> DataFrame:
    """(doc_id, text) to context passages: section, start, stop (characters from 0), text.

    Sections end at the next heading; a passage has most characters at most, and is cut after the last line end from least on, if there is one. Blank ones go.
    """
    heading = rf"(?im)^[#*=\-\s]*({heading_pattern()})[:\s\-*=#]*$"
    x = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", heading, "\x01$0"), "\x01")).alias("part", "body"))
    section = F.when(F.col("part") == 0, "UNCLASSIFIED").otherwise(F.regexp_replace(F.upper(F.regexp_extract("body", heading, 1)), r"\s+", " "))
    cut = F.regexp_extract_all("body", F.lit(rf"(?s).{{1,{most}}}\z|.{{{least},{most - 1}}}\n|.{{{most}}}"), F.lit(0))
    x = x.select("doc_id", "part", section.alias("section"), F.posexplode(cut).alias("piece", "text"))
    w = Window.partitionBy("doc_id").orderBy("part", "piece")
    start = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("start", start).withColumn("stop", F.col("start") + F.length("text"))
    return x.where(F.col("text").rlike(r"\S")).select("doc_id", "section", "start", "stop", "text")


def prompts(sentences: DataFrame) -> DataFrame:
    """Sentences (pair_id, category, ordinal, text) to one text for each pair: a line for each distinct sentence, with the handles of all places where it stands."""
    letter = F.create_map(*[F.lit(v) for kv in LETTERS.items() for v in kv])[F.col("category")]
    code = F.concat(letter, F.col("ordinal").cast("string"))
    x = sentences.groupBy("pair_id", "text").agg(F.array_join(F.array_sort(F.collect_set(code)), ",").alias("handles"), F.min(F.struct("category", "ordinal")).alias("first"))
    line = F.concat(F.lit("["), "handles", F.lit("] "), escape_xml(F.col("text")))
    lines = F.array_sort(F.collect_list(F.struct("first", line.alias("line"))))
    return x.groupBy("pair_id").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("prompt"))


@F.udtf(returnType="chunk_index int, text string, char_length int")
class ChunkText:
    """The chunker as a table function for SQL: chunk_text(section, content); the same chunks as sections.chunks() gives."""

    def eval(self, section: str, content: str) -> Iterator[tuple[int, str, int]]:
        prefix = f"[Section: {section}] "
        cap, out, pending = MOST - len(prefix), [], ""
        rule = re.compile(rf"(?s)\S.{{0,{cap - 1}}}(?= |\Z)|\S.{{{cap - 1}}}")
        for block in re.split(BLOCK_ENDS, content or ""):
            block = block.strip(BLANK)
            for piece in ([block] if len(block) <= cap else rule.findall(block)) if len(block) > 5 else ():
                joined = f"{pending} {piece.strip(BLANK)}" if pending else piece.strip(BLANK)
                if len(joined) > cap:
                    out.append(pending)
                    pending = piece.strip(BLANK)
                elif len(joined) >= LEAST:
                    out.append(joined)
                    pending = ""
                else:
                    pending = joined
        for k, body in enumerate([*out, *([pending] if pending else [])]):
            yield k, prefix + body, len(body)


def register(spark: SparkSession) -> None:
    """Makes chunk_text known to SQL."""
    spark.udtf.register("chunk_text", ChunkText)


#: Longest title and header, a year that makes the block before it a title, starts that no title has, bounds of page-aware chunks.
TITLE, HEADER, YEAR, NO_TITLE = 180, 160, r"\b(?:19|20)\d{2}\b", r"(?i)^[-•*]|^(?:technologies|tech stack|skills)\s*:"
PAGE_LEAST, PAGE_MOST, ENTRIES = 400, 420, ("EXPERIENCE", "PROJECTS")


def page_chunks(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_number, block_no, text), each a heading or text, to chunks of entries: section, entry, chunk_index, page_number, block_no, blocks, text.

    A heading opens its section and an entry; so does, in experience and projects, a short title: one before a block with a year, or, in
    projects, with a bar. Later chunks of an entry repeat its header, the first two blocks. page_number and block_no are those of the entry's
    first block, blocks how many it has.
    """
    w = Window.partitionBy("doc_id").orderBy("page_number", "block_no")
    whole = F.btrim("text", F.lit(BLANK))
    heading = rf"(?i)^[#*=\-\s]*({heading_pattern()})[:\s\-*=#]*$"
    named = F.lit(None).cast("string")
    for name in HEADINGS:
        named = F.when(F.regexp_extract(whole, heading, 1).rlike(f"(?i)^(?:{heading_pattern(name)})$"), name).otherwise(named)
    x = blocks.withColumn("named", named).withColumn("after", F.coalesce(F.lead("text").over(w), F.lit("")))
    x = x.withColumn("section", F.coalesce(F.last("named", ignorenulls=True).over(w), F.lit("EXPERIENCE")))
    marked = F.col("after").rlike(YEAR) | ((F.col("section") == "PROJECTS") & F.contains("text", F.lit("|")))
    title = F.col("section").isin(*ENTRIES) & (F.length(whole) < TITLE) & marked & ~whole.rlike(NO_TITLE)
    x = x.withColumn("entry", F.sum((F.col("named").isNotNull() | title).cast("int")).over(w)).where("named is null")
    row = F.struct("page_number", "block_no", whole.alias("text"))
    e = x.groupBy("doc_id", "entry").agg(F.first("section").alias("section"), F.array_sort(F.collect_list(row)).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n")
    header = F.left(F.array_join(F.transform(F.slice("rows", 1, 2), lambda r: r["text"]), " "), F.lit(HEADER))
    e = e.select(F.struct("doc_id", "entry", F.col("rows")[0]["page_number"].alias("page_number"), F.col("rows")[0]["block_no"].alias("block_no"), F.size("rows").alias("blocks"), header.alias("header")).alias("doc_id"), "section", body.alias("content"))
    c = chunks(e, PAGE_LEAST, PAGE_MOST).select("doc_id.*", "section", "chunk_index", "text")
    prefix = F.concat(F.lit("[Section: "), "section", F.lit("] "))
    again = F.concat(prefix, "header", F.lit("\n"), F.substr("text", F.length(prefix) + 1))
    return c.withColumn("text", F.when((F.col("chunk_index") > 0) & F.col("section").isin(*ENTRIES), again).otherwise(F.col("text"))).drop("header")
