"""Relations derived from the given tables, once for Spark and once as SQL for DuckDB.

orders stand for pairs of a document (customer) and a job (order priority), events for telemetry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators.ranking import TERMINAL

OPEN = ("PENDING", "STAGE1_READY", "STAGE2_READY", "SHORTLISTED", "EVALUATING")
STATES = (*TERMINAL, *OPEN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small file over as many tasks as a shuffle has, for work that is heavy for each row: a file of a few MB is one task however long its rows take.

    The number is named, since a shuffle of so few bytes would else be put together again.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("o_orderkey") % len(STATES) + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("job"),
        (F.col("o_totalprice") / 5000.0).alias("score"), (F.col("o_orderkey") % 7).alias("responsibility"), (F.col("o_orderkey") % 5).alias("applied"),
        (F.col("o_orderkey") % 4 != 0).alias("eligible"), state.alias("status"),
    )


PAIRS = f"""pairs AS (SELECT o_orderkey AS pair_id, o_custkey AS doc_id, o_orderpriority AS job, o_totalprice / 5000.0 AS score,
 o_orderkey % 7 AS responsibility, o_orderkey % 5 AS applied, o_orderkey % 4 <> 0 AS eligible,
 ([{', '.join(f"'{s}'" for s in STATES)}])[o_orderkey % {len(STATES)} + 1] AS status FROM orders)"""

#: A text with sections for each customer, in words that Spark and DuckDB both read.
PROFILE = """concat('Person ', cast(c_custkey as string), chr(10),
 CASE WHEN c_custkey % 4 = 0 THEN concat('user', cast(c_custkey as string), '@example.com Kathmandu', chr(10)) ELSE '' END,
 CASE c_custkey % 3 WHEN 0 THEN concat('Total experience: ', cast(c_custkey % 9 as string), ' years', chr(10), chr(10)) ELSE '' END,
 'TECHNICAL SKILLS', chr(10),
 CASE c_custkey % 5 WHEN 0 THEN 'Java, Spring Boot, Postgres' WHEN 1 THEN 'C#, .NET, K8s' WHEN 2 THEN 'Python, Spark, SQL'
   WHEN 3 THEN 'JavaScript, NodeJS' ELSE 'Selenium, test automation' END, chr(10),
 'WORK EXPERIENCE', chr(10), 'Engineer | A', chr(10), '01/', cast(2012 + c_custkey % 5 as string), ' - 06/', cast(2015 + c_custkey % 4 as string), chr(10),
 CASE c_custkey % 7 WHEN 0 THEN 'Never built payment APIs in Java.' WHEN 1 THEN 'Built payment APIs in Java. Tested REST APIs.'
   WHEN 2 THEN 'Developed Spark pipelines with SQL.' WHEN 3 THEN 'Deployed .NET services on Kubernetes.'
   WHEN 4 THEN 'Automated regression tests in Selenium.' WHEN 5 THEN 'Payment APIs; Java certification.' ELSE 'Maintained Postgres and Node.js services.' END, chr(10),
 'Employment history:', chr(10), 'Engineer | B', chr(10), '03/', cast(2014 + c_custkey % 6 as string), ' - 09/', cast(2020 + c_custkey % 3 as string), chr(10),
 '== Projects ==', chr(10), CASE c_custkey % 2 WHEN 0 THEN 'Designed a reporting system for the team.' ELSE 'Implemented Spring Boot microservices.' END, chr(10),
 'EDUCATION', chr(10),
 CASE c_custkey % 6 WHEN 0 THEN 'Bachelor of Science in Computer Science, 2012' WHEN 1 THEN 'Bachelor in Information Technology - Expected 2026'
   WHEN 2 THEN 'Bachelor of Fine Arts, 2011' WHEN 3 THEN 'Master of Business Administration (MBA), 2014'
   WHEN 4 THEN 'High School Diploma, 2008' ELSE '' END)"""
PROFILES = f"profiles AS (SELECT c_custkey AS doc_id, {PROFILE} AS text FROM customer)"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").selectExpr("c_custkey as doc_id", f"{PROFILE} as text")
