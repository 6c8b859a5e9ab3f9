"""Masks, spans and names on single texts, and gates on odd ones."""

import pytest
from pyspark.sql import functions as F

from siftspark.functions.text import entropy
from siftspark.operators import masking, numbering, views


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("Tel +977-9812345678.", "Tel [REDACTED_PHONE]."), ("01-4412345 ext. 12, x", "[REDACTED_PHONE], x"), ("(212) 555-0199", "[REDACTED_PHONE]"), ("order 123456789012345678", "order 123456789012345678"),
        ("9801234567 9701234567", "[REDACTED_PHONE] [REDACTED_PHONE]"), ("in 2019 and 2020", "in 2019 and 2020"), ("", ""),
    ],
)
def test_phones(spark, text, masked):
    assert one(spark, masking.mask_phones(F.col("t")), t=text) == masked


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("Bachelor of Arts, 2011", "Bachelor of Arts, [PREVIOUS_ERA_YEAR]"), ("2011 to 2014: degree in Law", "[PREVIOUS_ERA_YEAR] to 2014: degree in Law"), ("Built in 2011", "Built in 2011"),
        ("degree\n2011", "degree\n2011"), ("B.Sc. 1999; 2001", "B.Sc. [PREVIOUS_ERA_YEAR]; 2001"),
    ],
)
def test_degree_years(spark, text, masked):
    assert one(spark, masking.mask_degree_years(F.col("t")), t=text) == masked


def test_spans_from_right_to_left_and_technologies_stay(spark):
    texts = spark.createDataFrame([(1, "Ada Berg met Apache Spark in Oslo"), (2, "nobody"), (3, None)], "doc_id long, text string")
    spans = [(1, 0, 8, "PERSON"), (1, 13, 25, "PERSON"), (1, 29, 33, "GPE"), (1, 29, 33, "GPE"), (2, 0, 6, "ORG"), (3, 0, 2, "PERSON")]
    got = {r.doc_id: r.text for r in masking.apply_spans(texts, spark.createDataFrame(spans, "doc_id long, start int, stop int, label string")).collect()}
    assert got == {1: "[REDACTED_NAME] met Apache Spark in [REDACTED_LOCATION]", 2: "nobody", 3: None}


def test_entropy_and_readable(spark):
    assert one(spark, entropy(F.col("t")), t="") == 0.0 and one(spark, entropy(F.col("t")), t="aaaa") == 0.0 and one(spark, entropy(F.col("t")), t="abcd") == 2.0 and one(spark, entropy(F.col("t")), t=None) == 0.0
    good = "Four words are readable enough for this"
    assert one(spark, masking.readable(F.col("t")), t=good) and not one(spark, masking.readable(F.col("t")), t="a b c d e") and not one(spark, masking.readable(F.col("t")), t=good + "�\x01")
    assert one(spark, masking.readable(F.col("t")), t=good + "​​\n\t")


def test_assembly_limits(spark):
    rows = [(1, 1, 2, 10, 10, False, "b"), (1, 1, 1, 10, 10, False, "a"), (1, 2, 1, 10, 10, True, "c"), (2, 1, 1, 10, 10, True, "x"), (2, 2, 1, 10, 10, True, "y"), (3, 1, 1, 9000, 9000, False, "z")]
    x = spark.createDataFrame(rows, "doc_id long, page_number int, block_no int, width int, height int, needs_ocr boolean, text string")
    got = {r.doc_id: (r.status, r.code, r.text) for r in masking.assembled(x, ocr_pages=1).collect()}
    assert got == {1: ("success", "OK", "a\n\nb\n\nc"), 2: ("review", "OCR_PAGE_LIMIT", None), 3: ("failure", "PDF_PAGE_DIMENSIONS", None)}


def test_places_in_one_large_group(spark):
    x = spark.range(1000).select(F.lit("a").alias("g"), (F.col("id") % 10).alias("s"), "id", (F.col("id") % 3 == 0).alias("ok"))
    got = numbering.numbered(x, "g", [F.desc("s"), F.col("id")], "place", ("ok", "nth")).orderBy("place").collect()
    want = sorted(range(1000), key=lambda i: (-(i % 10), i))
    assert [r.id for r in got] == want and [r.place for r in got] == list(range(1, 1001))
    seen = 0
    for r in got:
        seen += r.ok
        assert r.nth == seen
    assert numbering.numbered(x.limit(0), "g", [F.col("id")]).count() == 0


def test_saved_views_are_checked():
    allowed = {"status": str, "score": float}
    for bad in ('{"x": 1}', '{"status": 3}', '{"score": {"from": "a", "to": null}}', "[]"):
        with pytest.raises(ValueError):
            views.saved_view(bad, allowed)
