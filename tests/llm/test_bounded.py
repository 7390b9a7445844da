"""What is broadcast goes by rows."""

from judge_jobs.llm import common
from judge_jobs.llm.common import table


def test_above_its_bound_nothing_is_broadcast(spark):
    """Though its file is small: packed ids take a bit each."""
    ids = table(spark.range(50_000).selectExpr("id as k", "1L as v"), "ids")
    other = spark.range(1000).selectExpr("id as k")
    plan = lambda most: other.join(common.bounded(ids, most), "k", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(50_000) and "Broadcast" not in plan(49_999)
