from judge_jobs.operators import calibration, small
from pyspark.sql import functions as F


def test_sides_are_sent_only_if_they_are_small(spark, monkeypatch):
    rows, few = spark.range(100).withColumn("k", F.col("id") % 5), spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    plan = lambda most: rows.join(small.sent_if_small(few, most), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(5) and "strategy=broadcast" not in plan(4)
    assert rows.join(small.sent_if_small(few, 4), "k").count() == rows.join(small.sent_if_small(few, 5), "k").count() == 100


def test_a_large_policy_joins_all_the_same(spark, monkeypatch):
    policy = spark.range(50).select(F.col("id").cast("string").alias("dimension"), (F.col("id") % 2 == 0).alias("trusted"))
    calls = spark.range(60).select(F.col("id").cast("string").alias("dimension"))
    flags = lambda: {r.dimension: r.escalate_to_human for r in calibration.annotate(calls, policy).collect()}
    sent = flags()
    monkeypatch.setattr(small, "SENT", 3)
    monkeypatch.setattr(calibration, "sent_if_small", lambda df: small.sent_if_small(df, 3))
    assert flags() == sent and sent["2"] is False and sent["3"] and sent["59"]
