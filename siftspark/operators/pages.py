"""Page blocks in reading order, and texts made safe to store and to show."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far past the middle a block of full width reaches, what a removed contact line becomes, headings that end the header.
MARGIN, CONTACT, HEADER_CHARS = 40, "[REDACTED_CONTACT]", 400
BODY_STARTS = ("summary", r"professional\s+summary", "experience", r"work\s+history", "education", "skills", r"technical\s+skills")
#: Code points that XML text may hold.
XML = r"\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}"


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_number, block_no, block_type, x0, y0, x1, y1, text) with place on the page; images and blank blocks go.

    Blocks of full width cut a page into runs; in each run the left column goes before the right one, and the cutting block ends it.
    """
    page = Window.partitionBy("doc_id", "page_number")
    down = page.orderBy("y0", "x0", "block_no")  # one order for all windows before the last: a task sorts its rows once for them, not for each
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = blocks.where((F.col("block_type") == 0) & F.col("text").rlike(r"\S"))
    x = x.withColumn("mid", (F.min("x0").over(whole) + F.max("x1").over(whole)) / 2)
    wide = (F.col("x0") < F.col("mid") - MARGIN) & (F.col("x1") > F.col("mid") + MARGIN)
    side = F.when(wide, 2).when(F.col("x1") <= F.col("mid") + MARGIN, 0).otherwise(1)
    x = x.withColumn("side", side).withColumn("wide", (side == 2).cast("int"))
    # of cutting blocks at or above a block, those at its own height count too; a cutting block itself counts those before it
    above = F.sum("wide").over(page.orderBy("y0").rangeBetween(Window.unboundedPreceding, 0))
    before = F.sum("wide").over(down.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("run", F.when(F.col("wide") == 1, F.coalesce(before, F.lit(0))).otherwise(above))
    x = x.withColumn("place", F.row_number().over(page.orderBy("run", "side", "y0", F.when(F.col("wide") == 1, F.col("x0")), "block_no")))
    return x.drop("mid", "side", "wide", "run")


def xml_safe(text: Column) -> Column:
    """Each code point that XML does not allow becomes a blank, so that offsets stay."""
    return F.regexp_replace(text, f"[^{XML}]", " ")


def mask_lines(text: Column, patterns: list[str], mask: str = CONTACT) -> Column:
    """Lines with any of the patterns become the mask, whole."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda n: F.when(reduce(or_, [n.rlike(p) for p in patterns]), mask).otherwise(n)), "\n")


def header_and_body(text: Column) -> Column:
    """struct<header, body>, parted before the first heading after the first line, else after the first 400 characters."""
    at = F.regexp_instr(text, F.lit(rf"(?i)\n(?=(?:{'|'.join(BODY_STARTS)})\b)"))
    n = F.when(at > 1, at - 1).otherwise(F.least(F.length(text), F.lit(HEADER_CHARS)))
    return F.struct(F.left(text, n).alias("header"), F.substr(text, n + 1).alias("body"))


def leaks(masked: DataFrame, known: DataFrame, mail: str) -> DataFrame:
    """One row: texts, those that still match the mail pattern, and those that hold the known name or mail address of their document."""
    x = masked.join(known, "doc_id", "left")
    holds = lambda c: F.coalesce(F.contains(F.lower("text"), F.lower(c)), F.lit(False))
    return x.agg(
        F.count("*").alias("texts"), F.count_if(F.col("text").rlike(mail)).alias("mail_pattern"), F.count_if(holds("name")).alias("known_name"), F.count_if(holds("mail")).alias("known_mail")
    )


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to sentences: ordinal (from 1), start (characters before it), sentence. Decimal points and line ends do not end one; blank ones have no row."""
    cut = F.split("text", r"(?<=[!?])(?=\s)|(?<=\.)(?=\s+[A-Z])")
    x = docs.select("doc_id", F.posexplode(cut).alias("no", "sentence"))
    w = Window.partitionBy("doc_id").orderBy("no")
    x = x.withColumn("start", F.coalesce(F.sum(F.length("sentence")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.where(F.col("sentence").rlike(r"\S")).select("doc_id", F.row_number().over(w).alias("ordinal"), "start", "sentence")
