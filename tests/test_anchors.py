"""Passages held by other texts: as by looking at all pairs, with words shuffled as hashes."""

import pytest
from pyspark.sql import functions as F

from siftspark.operators import anchors
from siftspark.plans import PLANS

TEXTS = ["a b c", "a b", "b c", "x", "b", "", " ", None, "c a b c", "a  b"]
ROWS = [(k, own, t) for k in (1, 2, None) for own, t in enumerate(TEXTS)] + [(1, None, "b c"), (1, 9, "a b c"), (2, 9, "x"), (2, None, None)]
SCHEMA = "k int, own int, text string"


def test_held_is_what_all_pairs_give(spark):
    x = spark.createDataFrame(ROWS, SCHEMA).withColumn("k", F.struct("k"))
    got = sorted(str((r.k.k, r.own, r.text)) for r in anchors.held(x, x).collect())
    inside = lambda p, t: f" {' '.join(p.split())} " in f" {' '.join(t.split())} "
    want = {(k, o, p) for k, o, p in ROWS for j, q, t in ROWS if p and p.strip() and t and j == k and (o is None or q is None or o != q) and p in t and inside(p, t)}
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("name", ["manifest_dedup", "manifest_containment"])
def test_words_are_shuffled_without_keys_and_texts(spark, name):
    plan = PLANS[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    by_word = [x for x in plan.splitlines() if "Exchange" in x and "word#" in x]
    assert by_word and all(x.split("hashpartitioning(")[1].startswith("word#") for x in by_word) and "md5" not in plan
