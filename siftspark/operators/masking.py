"""Personal data masked in texts, and gates on whether a text can be read: column expressions, nothing here shuffles but what joins tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.text import mask_mail
from siftspark.operators.pages import header_and_body

#: The patterns of phones and of years of degrees, names of places, technologies that are no names of persons, and the masks.
NUMBER = r"(?:(?:\+?977[-.\s]?)?(?:9[78]\d{8}|0\d{1,2}[-.\s]?\d{6,7})|(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4})"
EXTENSION = r"(?:\s*(?:x|ext\.?|extension)\s*\d+)"
PLACES = (
    r"kathmandu|lalitpur|bhaktapur|pokhara|kavre|kavrepalanchok|chitwan|butwal|biratnagar|dharan|nepalgunj|banepa|dhulikhel"
    r"|ward\s*(?:no\.?)?\s*\d+|metro(?:politan)?|sub-metro|municipality|gaupalika|nagarpalika|tole|marga|chowk"
)
YEAR = r"19\d{2}|20[01]\d"
DEGREE_WORDS = (
    r"graduated|graduation|degree|batch\s+of|completed|class\s+of|bachelor(?:'s)?|master(?:'s)?|phd|doctorate|bca|bit|slc|see|\+2"
    r"|b\.?e\b\.?|b\.?sc\b\.?"
)
TECHNOLOGIES = (
    "julia", "delphi", "cassandra", "clojure", "solr", "spark", "hadoop", "jenkins", "postman", "haskell", "erlang", "elixir", "neo4j", "tableau", "spring", "ruby", "rust", "redis",
    "linux", "darwin", "oracle", "grafana",
)
PHONE = rf"(?i)(?<!\d){NUMBER}(?!\d){EXTENSION}?"
PHONE_MASK, PLACE_MASK, YEAR_MASK, NAME_MASK = "[REDACTED_PHONE]", "[REDACTED_LOCATION]", "[PREVIOUS_ERA_YEAR]", "[REDACTED_NAME]"
LABELS = {"PERSON": NAME_MASK, "GPE": PLACE_MASK, "LOC": PLACE_MASK, "FAC": PLACE_MASK}
#: First lines that are headings, and the form of one part of a name.
NOT_NAMES = ("SUMMARY", "PROFILE", "EXPERIENCE", "WORK EXPERIENCE", "PROFESSIONAL EXPERIENCE", "SKILLS", "TECHNICAL SKILLS", "EDUCATION", "PROJECTS")
_LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
NAME_PART = rf"{_LETTERS}(?:[-'’]{_LETTERS})*\.?"
#: Bounds of the gates.
ENTROPY, DENSITY, WORDS, LETTERS, ARTEFACTS = (3.5, 5.0), 0.70, 4, 25, 0.01


def mask_phones(text: Column) -> Column:
    """Phone numbers with their extensions; longer runs of digits stay."""
    return F.regexp_replace(text, PHONE, PHONE_MASK)


def mask_places(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?i)\b(?:{PLACES})\b", PLACE_MASK)


def mask_degree_years(text: Column) -> Column:
    """Years that stand near a word of education on the same line, on either side; all others stay."""
    words = rf"\b(?:{DEGREE_WORDS})"
    return F.regexp_replace(text, rf"(?i)({words}\b[^\n;]{{0,60}}?\b)(?:{YEAR})\b|\b(?:{YEAR})(\b[^\n;]{{0,40}}?{words})", f"$1{YEAR_MASK.replace('$', '')}$2")


def mask_zones(text: Column) -> Column:
    """The header without mail addresses, phones and places, then the body without mail addresses, phones and years of degrees."""
    zones = header_and_body(text)
    return F.concat(mask_places(mask_phones(mask_mail(zones["header"]))), mask_degree_years(mask_phones(mask_mail(zones["body"]))))


def find_spans(texts: DataFrame, recogniser: Callable[[], Callable[[str], list[tuple[int, int, str]]]]) -> DataFrame:
    """(doc_id, text) to spans doc_id, start, stop, label (characters from 0). recogniser() loads a model once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = recogniser()
        for b in batches:
            rows = [(i, *span) for i, t in zip(b["doc_id"], b["text"].fillna(""), strict=True) for span in model(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "label"])

    return texts.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, start int, stop int, label string")


def apply_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """texts (doc_id, text) with spans (doc_id, start, stop, label; characters from 0) masked from right to left.

    Spans of other labels, and persons of whom a word is a technology, stay. A document holds its own
    spans only, as many as it has words at most.
    """
    s = spans.where(F.col("label").isin(*LABELS)).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "label")), asc=False).alias("_spans"))
    mask = F.create_map(*[F.lit(v) for kv in LABELS.items() for v in kv])

    def put(text: Column, x: Column) -> Column:
        hit = F.substr(text, x["start"] + 1, x["stop"] - x["start"])
        known = (x["label"] == "PERSON") & F.arrays_overlap(F.split(F.lower(hit), r"\s+"), F.array(*map(F.lit, TECHNOLOGIES)))
        return F.when(known, text).otherwise(F.overlay(text, mask[x["label"]], x["start"] + 1, x["stop"] - x["start"]))

    x = texts.join(s, "doc_id", "left")
    return x.withColumn("text", F.coalesce(F.aggregate("_spans", F.col("text"), put), F.col("text"))).drop("_spans")


def first_line_name(text: Column) -> Column:
    """The first line where it has the form of a name of one to six parts and is no heading, else null."""
    line = F.trim(F.substring_index(text, "\n", 1))
    return F.when(line.rlike(rf"^{NAME_PART}(?:\s+{NAME_PART}){{0,5}}$") & ~F.upper(line).isin(*NOT_NAMES), line)


def mask_first_names(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, block_no, text): the name in the first line of a document's first block, and its repeats in all blocks, whatever their case."""
    first = blocks.where("page_number = 1 and block_no = 0").select("doc_id", first_line_name(F.col("text")).alias("_name")).where("_name is not null").dropDuplicates(["doc_id"])
    x = blocks.join(first, "doc_id", "left")
    repeats = F.regexp_replace("text", F.concat(F.lit(r"(?iU)(?<!\w)\Q"), "_name", F.lit(r"\E(?!\w)")), F.lit(NAME_MASK))
    return x.withColumn("text", F.when(F.col("_name").isNull(), F.col("text")).otherwise(repeats)).drop("_name")


def integrity_gate(entropy: Column, density: Column, least_density: float = DENSITY) -> Column:
    """struct<passed, reasons>: the entropy lies in its range, the share of known words is high enough."""
    reasons = F.array_compact(F.array(F.when(~entropy.between(*ENTROPY), "ENTROPY"), F.when(density < least_density, "DENSITY")))
    return F.struct((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def readable(text: Column) -> Column:
    """Whether a text has words and letters enough, and few characters that decoding leaves behind."""
    words = F.regexp_extract_all(text, F.lit(rf"({_LETTERS})"))
    letters = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    left_behind = F.regexp_count(text, F.lit(r"[\x{FFFD}[\p{C}\p{Zl}\p{Zp}&&[^\s\x{1C}-\x{1F}\x{85}\x{2028}\x{2029}\x{200B}\x{200C}\x{200D}\x{FEFF}]]]"))
    return (F.size(words) >= WORDS) & (letters >= LETTERS) & (left_behind / F.greatest(F.length(text), F.lit(1)) <= ARTEFACTS)


def assembled(blocks: DataFrame, pages: int = 50, area: int = 10_000_000, page_blocks: int = 2_000, page_chars: int = 200_000, chars: int = 500_000, ocr_pages: int = 20) -> DataFrame:
    """Blocks (doc_id, page_number, block_no, width, height, needs_ocr, text) to documents: status (success, review, failure), code, text.

    The first page over a limit decides; more pages than allowed fail the document. Texts of blocks,
    then of pages, are joined by blank lines.
    """
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"]), "\n\n")
    p = blocks.groupBy("doc_id", "page_number").agg(F.max(F.col("width") * F.col("height")).alias("area"), F.count("*").alias("n"), F.max("needs_ocr").alias("ocr"), body.alias("text"))
    w = Window.partitionBy("doc_id").orderBy("page_number")
    before = F.sum(F.col("ocr").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("upto", F.sum(F.length("text")).over(w))
    code = (
        F.when(F.col("area") > area, "PDF_PAGE_DIMENSIONS").when(F.col("n") > page_blocks, "PDF_BLOCK_LIMIT").when(F.length("text") > page_chars, "PDF_TEXT_LIMIT")
        .when(F.col("ocr") & (F.col("before") >= ocr_pages), "OCR_PAGE_LIMIT").when(F.col("upto") > chars, "PDF_TEXT_LIMIT")
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda b: b["text"]), "\n\n")
    x = p.withColumn("code", code).groupBy("doc_id").agg(
        F.when(F.count("*") > pages, "PDF_PAGE_LIMIT").otherwise(F.coalesce(F.min_by("code", F.when(F.col("code").isNotNull(), F.col("page_number"))), F.lit("OK"))).alias("code"), text.alias("text")
    )
    status = F.when(F.col("code") == "OK", "success").when(F.col("code") == "OCR_PAGE_LIMIT", "review").otherwise("failure")
    return x.select("doc_id", status.alias("status"), "code", F.when(F.col("code") == "OK", F.col("text")).alias("text"))
