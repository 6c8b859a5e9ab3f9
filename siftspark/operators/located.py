"""Chunks of pages' blocks that keep where they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .context import ENTRIES, HEADER, NO_TITLE, PAGE_LEAST, PAGE_MOST, TITLE, YEAR
from .sections import BLANK, category, heading_pattern, in_order, packed, section_of


def entries(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_number, block_no, bbox, text) to entries: doc_id, entry, section, locations, contents.

    A block may be a heading, text, or both: one with headings inside is cut at them, and each part opens its section and an entry; the
    last one's section lasts over later blocks and pages until another opens. A short title opens an entry too, in experience and
    projects: one whose next block, on its page or first on the next, has a year, or, in projects, one with a bar.
    locations (page_number, block_no, bbox) and contents run side by side, in order. Blank blocks and headings without text add nothing.
    """
    w = Window.partitionBy("doc_id").orderBy("page_number", "block_no")
    whole = F.btrim("text", F.lit(BLANK))
    pattern = rf"[#*=\-\s]*({heading_pattern()})[:\s\-*=#]*"
    alone = F.coalesce(whole.rlike(rf"(?i)\A{pattern}\z"), F.lit(False))
    after = F.lead(F.struct("page_number", "text")).over(w)
    x = blocks.select("doc_id", "page_number", "block_no", "bbox", "text", after.alias("_next"), alone.alias("_alone"), F.col("text").rlike(rf"(?imd)^{pattern}$").alias("_inside"))
    opened = F.array(F.struct(section_of(F.regexp_extract(whole, rf"(?i)\A{pattern}\z", 1)).alias("section"), F.lit("").alias("content")))
    x = x.withColumn("_parts", F.when(F.col("_alone"), opened).otherwise(in_order(F.col("text"))))
    near = F.coalesce(F.col("_next.page_number") - F.col("page_number") <= 1, F.lit(False))
    year = F.coalesce(near & F.col("_next.text").rlike(YEAR), F.lit(False))
    x = x.select("doc_id", "page_number", "block_no", "bbox", "_alone", "_inside", year.alias("_year"), F.posexplode("_parts").alias("_k", "_p"))
    w = Window.partitionBy("doc_id").orderBy("page_number", "block_no", "_k")
    opens = F.col("_alone") | F.col("_inside")
    x = x.withColumn("section", F.coalesce(F.last(F.when(opens, F.col("_p.section")), ignorenulls=True).over(w), F.lit("EXPERIENCE")))
    text = F.col("_p.content")
    marked = F.col("_year") | ((F.col("section") == "PROJECTS") & F.contains(text, F.lit("|")))
    title = F.col("section").isin(*ENTRIES) & (F.length(text) < TITLE) & marked & ~text.rlike(NO_TITLE)
    x = x.withColumn("entry", F.sum((opens | title).cast("int")).over(w)).where(~F.col("_alone"))
    row = F.struct("page_number", "block_no", "_k", "bbox", text.alias("content"))
    x = x.groupBy("doc_id", "entry").agg(F.first("section").alias("section"), F.array_sort(F.collect_list(row), lambda a, b: _before(a, b)).alias("_rows"))
    place = lambda r: F.struct(r["page_number"].alias("page_number"), r["block_no"].alias("block_no"), r["bbox"].alias("bbox"))
    return x.select("doc_id", "entry", "section", F.transform("_rows", place).alias("locations"), F.transform("_rows", lambda r: r["content"]).alias("contents"))


def _before(a, b):
    key = lambda r: F.struct(r["page_number"], r["block_no"], r["_k"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def located_chunks(blocks: DataFrame, least: int = PAGE_LEAST, most: int = PAGE_MOST) -> DataFrame:
    """Blocks, as for entries(), to chunks: doc_id, global_chunk_id, section, category, chunk_index, text, char_length, page_number, block_no, bbox, locations.

    Later chunks of an entry of experience or projects repeat its header, the first two contents. page_number, block_no and bbox are those of
    the entry's first block, locations those of all of them; global_chunk_id runs from 0 through the document.
    """
    header = F.left(F.array_join(F.slice("contents", 1, 2), " "), F.lit(HEADER))
    x = entries(blocks).withColumn("_header", header).withColumn("_body", F.array_join("contents", "\n\n"))
    x = x.select("doc_id", "entry", "section", "locations", "_header", F.posexplode(packed(F.col("section"), F.col("_body"), least, most)).alias("chunk_index", "_chunk"))
    again = (F.col("chunk_index") > 0) & F.col("section").isin(*ENTRIES)
    x = x.withColumn("_chunk", F.when(again, F.concat("_header", F.lit("\n"), "_chunk")).otherwise(F.col("_chunk")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("entry", "chunk_index")) - 1
    text = F.concat(F.lit("[Section: "), "section", F.lit("] "), "_chunk")
    return x.select(
        "doc_id", n.alias("global_chunk_id"), "section", category(F.col("section")).alias("category"), "chunk_index", text.alias("text"), F.length("_chunk").alias("char_length"),
        *[F.col("locations")[0][c].alias(c) for c in ("page_number", "block_no", "bbox")], "locations",
    )
