"""Where a query and its SQL once parted: ties, halves and neighbours that share a character."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from siftspark.operators import masking, ranking, views
from siftspark.plans import ORACLES
from siftspark.plans.masking import all_phones_sql


def test_equal_spans_are_of_one_island(spark, tmp_path):
    con = duckdb.connect()
    # of each customer an early span, then one that stands twice: 1 + 2 months, in two islands
    con.execute(f"""COPY (SELECT 9 * (4 * c + k) AS o_orderkey, c AS o_custkey, TIMESTAMP '2000-01-01' + to_months(CAST(CASE k WHEN 0 THEN 0 ELSE 5 END AS INTEGER)) AS o_orderdate FROM range(200000) x(c), (VALUES (0), (1), (2)) v(k)) TO '{tmp_path}/orders.parquet'""")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert con.sql(f"SELECT DISTINCT months, most_years FROM ({ORACLES['experience_months']})").fetchall() == [(2, 0.33)]
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    x = spark.read.parquet(f"{tmp_path}/orders.parquet").where("o_custkey < 2000").select(F.col("o_custkey").alias("who"), month.alias("a"), (month + 1).alias("b"))
    assert {(r.covered, r.islands) for r in ranking.merged_intervals(x, "who", "a", "b").collect()} == {(2, 2)}


def test_phones_that_share_a_blank(spark):
    made = random.Random(5)
    parts = [*"0123456789" * 3, *"+()-. \n" * 3, "977", "98", "01-", "x", "ext. ", "Extension", "a", "_", "\x0b", "é"]
    texts = ["+1 (826) 555-4081 190.137.223.204 x", *("".join(made.choices(parts, k=made.randint(5, 60))) for _ in range(3000))]
    want = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(masking.mask_phones(F.col("t")).alias("t")).collect()]
    assert want[0] == "[REDACTED_PHONE] [REDACTED_PHONE] x" and any(re.search(r"\S\[REDACTED_PHONE\]", t) for t in want)
    con = duckdb.connect()
    assert [con.execute(f"SELECT {all_phones_sql('$1')}", [t]).fetchone()[0] for t in texts] == want


def test_scores_of_other_roles_round_by_their_exact_value(spark):
    scores = [99.25, 99.75, 0.15, 0.25, 0.35, 12345.65, -0.25, 2.0]
    x = spark.createDataFrame([(k, k, j, s if j == "b" else 0.0) for k, s in enumerate(scores) for j in "ab"], "pair_id long, doc_id long, job string, score double")
    got = [r.roles for r in views.other_roles(x).where("job = 'a'").orderBy("pair_id").collect()]
    assert got == [f"b={s:.1f}" for s in scores]
