"""Tables that grow with the input are joined by shuffles, whatever their files' sizes say."""

import pytest

from siftspark.plans import PLANS


@pytest.mark.parametrize("name", ["concept_plan", "target_concepts", "resolve_targets"])
def test_plans_of_concepts_send_no_table_through_the_driver(spark, name):
    plan = PLANS[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_replayed_scores_are_not_dealt_by_run(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = PLANS["score_replay"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
