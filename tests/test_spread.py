"""Work that is heavy for each row is dealt over all tasks, though its file is one split."""

from siftspark.plans import PLANS
from siftspark.plans.relations import profiles, table


def test_profiles_of_one_small_file_are_many_tasks(spark):
    d = "/root/testdata/sf0.001"
    assert table(spark, d, "customer").rdd.getNumPartitions() == 1
    x = profiles(spark, d)
    assert x.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert x.count() == table(spark, d, "customer").count()


def test_document_chunks_deals_its_texts(spark):
    plan = PLANS["document_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
