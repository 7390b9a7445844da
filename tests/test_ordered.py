import numpy as np
import pandas as pd
import pytest
from judge_jobs.operators import calibration, ordered
from pyspark.sql import functions as F


def rows(spark, kind, n=900, seed=0):
    rng = np.random.default_rng(seed)
    values = {"continuous": rng.normal(0, 1, n), "whole": rng.integers(1, 6, n).astype(float), "one": np.full(n, 3.0), "skewed": np.where(rng.random(n) < 0.4, 2.5, rng.exponential(1, n))}[kind]
    return pd.DataFrame({"g": [f"g{k % 3}" if k % 3 else None for k in range(n)], "v": values})


@pytest.mark.parametrize("kind", ["continuous", "whole", "one", "skewed"])
@pytest.mark.parametrize("parts", [2, 18, 256])
def test_running_counts(spark, kind, parts):
    frame = rows(spark, kind)
    counted = spark.createDataFrame(frame).groupBy("g", "v").count()
    got = {(r.g, r.v): r.before for r in ordered.running_counts(counted, "v", ("g",), parts=parts).collect()}
    want = {(None if g != g else g, v): int((part.v < v).sum()) for g, part in frame.groupby("g", dropna=False) for v in part.v.unique()}
    assert {(None if g is None else g, v): n for (g, v), n in got.items()} == {(None if g is None or g != g else g, v): n for (g, v), n in want.items()}


@pytest.mark.parametrize("kind", ["continuous", "whole", "one", "skewed"])
@pytest.mark.parametrize("around", [0.0, 0.2])
def test_exact_quantiles(spark, kind, around):
    frame, probabilities = rows(spark, kind), (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)
    df = spark.createDataFrame(frame).union(spark.createDataFrame([("g1", None)], "g string, v double"))
    got = {r.g: r for r in ordered.exact_quantiles(df, "v", probabilities, ("g",), (F.max("v").alias("top"),), around).collect()}
    for g, part in frame.groupby("g", dropna=False):
        r = got[None if g != g else g]
        assert r.quantiles == pytest.approx(list(np.quantile(part.v, probabilities))) and r.n == len(part) and r.top == part.v.max()
    assert ordered.exact_quantiles(df.limit(0), "v", (0.5,), ("g",)).count() == 0


def test_ranks_of_continuous_scores(spark):
    frame = rows(spark, "skewed").assign(dimension="d")
    got = {r.v: r.rank for r in calibration.average_ranks(spark.createDataFrame(frame[["dimension", "v"]]), "v").collect()}
    want = frame.v.rank(method="average")
    assert got == pytest.approx(dict(zip(frame.v, want)))


def windows(plan):
    """Partition columns of every window of a plan."""
    found, nodes = [], [plan]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Window":
            found.append([str(x) for x in [node.partitionSpec().apply(k) for k in range(node.partitionSpec().length())]])
        nodes += [node.children().apply(k) for k in range(node.children().length())]
    return found


def test_no_window_over_a_whole_group(spark):
    """Values are only ordered within a part; windows over a group see a row for each part."""
    counted = spark.createDataFrame(rows(spark, "continuous")).groupBy("g", "v").count()
    plan = ordered.running_counts(counted, "v", ("g",))._jdf.queryExecution().optimizedPlan()
    assert sorted(len(w) for w in windows(plan)) == [1, 2]
    text = plan.toString()
    assert "_part" in text and "orderBy" not in text
