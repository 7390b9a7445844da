import math

import pytest
from judge_jobs.functions.significance import correlation_p
from judge_jobs.operators import calibration as cal
from pyspark.sql import functions as F

SCHEMA = "dimension string, judge_score double, human_score double"


def metrics(spark, rows):
    return {r.dimension: r for r in cal.by_dimension(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_exact_and_shifted(spark):
    rows = [("same", float(k), float(k)) for k in range(1, 6)] + [("up", k + 1.0, float(k)) for k in range(1, 6)] + [("down", k - 1.0, float(k)) for k in range(1, 6)] + [("back", 6.0 - k, float(k)) for k in range(1, 6)]
    m = metrics(spark, rows)
    assert m["same"].pearson_r == pytest.approx(1) and m["same"].mean_absolute_error == 0 and m["same"].n == 5
    assert (m["up"].mean_signed_error, m["down"].mean_signed_error) == (1, -1)
    assert m["back"].pearson_r == pytest.approx(-1) and m["back"].spearman_r == pytest.approx(-1)


def test_missing_small_and_constant_groups(spark):
    rows = [("a", 1.0, 2.0), ("a", None, 3.0), ("a", 2.0, 3.0), ("a", float("nan"), 1.0), ("lone", 1.0, 1.0), ("flat", 3.0, 1.0), ("flat", 3.0, 2.0), ("flat", 3.0, 5.0), (None, 1.0, 1.0)]
    m = metrics(spark, rows)
    assert set(m) == {"a", "flat"}
    assert m["a"].n == 2 and m["a"].pearson_p == 1 and m["a"].spearman_p is None
    assert m["flat"].pearson_r is None and m["flat"].pearson_p is None
    policy = {r.dimension: r for r in cal.policy(cal.by_dimension(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert not policy["flat"].trusted and policy["flat"].reason.startswith("not statistically significant")


def test_spearman_with_ties(spark):
    a, b = [1, 2, 2, 3, 5, 5, 5], [2.0, 1.0, 4.0, 4.0, 4.0, 6.0, 7.0]
    rank = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
    ra, rb = rank(a), rank(b)
    ma, mb = sum(ra) / 7, sum(rb) / 7
    want = sum((x - ma) * (y - mb) for x, y in zip(ra, rb)) / math.sqrt(sum((x - ma) ** 2 for x in ra) * sum((y - mb) ** 2 for y in rb))
    assert metrics(spark, [("d", float(x), y) for x, y in zip(a, b)])["d"].spearman_r == pytest.approx(want)


def p_values(spark, *cases):
    rows = spark.createDataFrame([(k, r, n) for k, (r, n) in enumerate(cases)], "k int, r double, n long")
    return [x.p for x in rows.coalesce(1).select("k", correlation_p(F.col("r"), F.col("n")).alias("p")).orderBy("k").collect()]


def test_published_p_values(spark):
    cases = {0.5504: 2.98e-9, 0.5507: 2.93e-9, 0.1550: 0.1235, 0.4826: 3.69e-7}
    assert p_values(spark, *[(r, 100) for r in cases]) == [pytest.approx(p, rel=0.02) for p in cases.values()]


def integrated(r, n):
    """The same tail by Simpson's rule over the density of r."""
    import numpy as np

    a = (n - 2) / 2
    top = min(1.0, abs(r) + 40 / math.sqrt(n)) if n > 50 else 1.0
    # u = 1 - v^2 takes the edge off the density where a is below 1
    v = np.linspace(math.sqrt(1 - top), math.sqrt(1 - abs(r)), 200_001)
    f = (v * v * (2 - v * v)) ** (a - 1) * 2 * v if a != 1 else 2 * v
    f = np.where(np.isfinite(f), f, 2 * math.sqrt(2) if a == 0.5 else 0)
    w = np.ones(len(v))
    w[1:-1:2], w[2:-1:2] = 4, 2
    area = float((f * w).sum() * (v[1] - v[0]) / 3)
    return 2 * area * math.exp(math.lgamma(a + 0.5) - math.lgamma(a) - 0.5 * math.log(math.pi))


def test_p_values_against_integration(spark):
    cases = [(r, n) for n in (3, 4, 5, 10, 47, 1000, 100_000) for r in (0.001, -0.01, 0.05, 0.3, -0.7, 0.95)]
    for (r, n), p in zip(cases, p_values(spark, *cases), strict=True):
        assert p == pytest.approx(integrated(r, n), rel=2e-5, abs=1e-280), (r, n)
    large = p_values(spark, *[(t / 1e4, 10**8) for t in (0.01, 0.5, 1.2, 1.8, 2.5, 6)])
    assert large == [pytest.approx(math.erfc(t / math.sqrt(2)), rel=2e-5) for t in (0.01, 0.5, 1.2, 1.8, 2.5, 6)]


def test_p_edges(spark):
    assert p_values(spark, (1.0, 10), (-1.0, 3), (0.0, 10), (0.3, 2), (None, 5), (0.5, 1), (float("nan"), 9), (0.5, None)) == [0, 0, 1, 1, None, None, None, None]


def test_no_python_worker_in_the_policy(spark):
    policy = cal.policy(cal.by_dimension(spark.createDataFrame([("a", 1.0, 2.0)], SCHEMA)))
    assert "Python" not in policy._jdf.queryExecution().executedPlan().toString()


RESULTS = [("coherence", 0.55, 1e-9, 100), ("consistency", 0.55, 1e-9, 100), ("fluency", 0.155, 0.123, 100), ("relevance", 0.48, 1e-6, 100), ("weak", 0.1, 0.001, 10000)]


def test_policy_and_flags(spark):
    policy = cal.policy(spark.createDataFrame(RESULTS, "dimension string, pearson_r double, pearson_p double, n long"))
    found = {r.dimension: r for r in policy.collect()}
    assert [d for d, r in found.items() if not r.trusted] == ["fluency", "weak"]
    assert found["fluency"].reason == "not statistically significant (p=0.1230 >= 0.05)"
    assert found["weak"].reason == "correlation too weak (|r|=0.100 < 0.3)"
    assert found["coherence"].reason == "significant (p=0.0000) and sufficiently strong (r=0.550)"
    calls = spark.createDataFrame([("coherence", True), ("coherence", False), ("fluency", True), ("readability", True), ("coherence", None)], "dimension string, parse_ok boolean")
    assert [r.escalated for r in cal.escalate_calls(calls.coalesce(1), policy).collect()] == [False, True, True, True, True]
    assert not any(r.escalated for r in cal.escalate_calls(calls, None).collect())
    rate = {r.dimension: r for r in cal.escalation_rate(cal.annotate(calls, policy)).collect()}
    assert rate[None].n_escalated == 2 and rate[None].is_total and rate["fluency"].escalation_rate == 1


def test_histograms(spark):
    df = spark.createDataFrame([(1.5,), (2.5,), (3.5,), (None,)], "x double")
    assert [tuple(r) for r in cal.histogram(df, cal.rounded(F.col("x"))).collect()] == [(2, 2), (4, 1)]
