"""Chunks in scope: a document's rows meet once, in one order, and are found as by plain rules."""

import pytest

from siftspark.operators import planning
from siftspark.plans import PLANS

DATA = "/root/testdata/sf0.001"
ROWS = [(d, c, n) for d in (1, 2, 3, None) for n, c in enumerate(["SKILLS", "EXPERIENCE", "EXPERIENCE", "OTHER", None][: 5 if d != 2 else 2])] + [(4, "EXPERIENCE", 1), (4, "PROJECTS", 1), (4, "SKILLS", 1), (5, "OTHER", 1)]
SCHEMA = "doc_id int, category string, chunk_id int"


def plain(rows, fallback=None):
    out = [(d, w, cs.index(c), n) for d, c, n in rows for w, cs in planning.SCOPES.items() if c in cs]
    if fallback:
        out += [(d, w, -1, n) for d, c, n in rows for w in planning.SCOPES if c == fallback and d is not None and not any(x[:2] == (d, w) for x in out)]
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "wanted", "place", "chunk_id").collect())


@pytest.mark.parametrize("fallback", [None, "EXPERIENCE", "SKILLS"])
def test_in_scope_by_plain_rules(spark, fallback):
    assert found(planning.in_scope(spark.createDataFrame(ROWS, SCHEMA), fallback)) == plain(ROWS, fallback)


@pytest.mark.parametrize("fallback", [None, "EXPERIENCE", "SKILLS"])
def test_once_is_one_hit(spark, fallback):
    from pyspark.sql import functions as F

    x = spark.createDataFrame(ROWS, SCHEMA)
    want = planning.one_hit(planning.in_scope(x, fallback).withColumn("rank", F.col("chunk_id")), ["doc_id", "wanted"])
    assert found(planning.in_scope(x, fallback, once=True)) == found(want)


@pytest.mark.parametrize(("name", "sorts"), [("scope_fallback", 1), ("scope_hits", 1), ("reading_order", 2)])
def test_rows_are_shuffled_once_and_sorted_no_more_than_needed(spark, name, sorts):
    plan = PLANS[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == sorts and "Join" not in plan and "Aggregate" not in plan
