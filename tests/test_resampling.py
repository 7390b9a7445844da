import numpy as np
import pandas as pd
import pytest
from judge_jobs.operators import resampling as rs

COLUMNS = ["model_pair", "metric", "doc_id", "score_a", "score_b"]


def pairs(spark, a, b, docs=None, name="p"):
    docs = range(len(a)) if docs is None else docs
    return spark.createDataFrame(pd.DataFrame({"model_pair": name, "metric": "m", "doc_id": [str(d) for d in docs], "score_a": a, "score_b": b}))


def normal(mean, sd, n=500, seed=0):
    return np.random.default_rng(seed).normal(mean, sd, n)


def test_bootstrap_covers_zero_only_without_effect(spark):
    none = rs.bootstrap(pairs(spark, normal(3, 1), normal(3, 1, seed=1)), 1000).first()
    assert none.ci_lower < 0 < none.ci_upper and none.n_units_resampled == 500
    large = rs.bootstrap(pairs(spark, normal(4.5, 0.5), normal(2.5, 0.5, seed=1)), 1000).first()
    assert large.ci_lower > 1.5 and large.ci_lower < large.point_estimate < large.ci_upper


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_seeded_whatever_the_partitions(spark, partitions):
    df = pairs(spark, np.arange(100.0), np.arange(100.0) * 0.9)
    again = df.repartition(partitions)
    assert rs.bootstrap(df, 300).collect() == rs.bootstrap(again, 300).collect()
    assert rs.permutation(df, 300).collect() == rs.permutation(again, 300).collect()
    a, b = (rs.bootstrap_large(x, "doc_id", 40).first() for x in (df, again))
    assert a.ci_lower == pytest.approx(b.ci_lower) and a.method == "poisson"


def test_clusters_widen_the_interval(spark):
    rng = np.random.default_rng(3)
    docs = np.repeat(np.arange(20), 16)
    a = 3 + np.repeat(rng.normal(0, 1.5, 20), 16) + rng.normal(0, 0.2, 320)
    b = 3 + np.repeat(rng.normal(0, 1.5, 20), 16) + rng.normal(0, 0.2, 320)
    df = pairs(spark, a, b, docs)
    rows, whole = rs.bootstrap(df, 600).first(), rs.bootstrap(df, 600, cluster="doc_id").first()
    assert whole.ci_upper - whole.ci_lower > 2 * (rows.ci_upper - rows.ci_lower)
    assert (rows.n_units_resampled, whole.n_units_resampled) == (320, 20)
    assert rs.bootstrap(df, 50, statistic="median_diff", cluster="doc_id").count() == 1


def test_median_ignores_an_outlier(spark):
    a = np.array([1.0, 2, 3, 4, 100])
    r = rs.bootstrap(pairs(spark, a, np.ones(5)), 200, statistic="median_diff").first()
    assert r.point_estimate == 2.0


def test_bad_arguments(spark):
    df = pairs(spark, np.ones(3), np.ones(3))
    for call in (lambda: rs.bootstrap(df, statistic="mode"), lambda: rs.bootstrap(df, cluster="article"), lambda: rs.permutation(df, alternative="other")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(Exception, match="exceeds full dataset size"):
        rs.sensitivity(df, [10], 1, 10, 10).collect()


def test_permutation(spark):
    assert rs.permutation(pairs(spark, normal(3, 1, 200), normal(3, 1, 200, 1)), 500).first().p_value > 0.05
    large = pairs(spark, normal(4, 1, 200), normal(3, 1, 200, 1))
    assert rs.permutation(large, 500).first().p_value < 0.01
    assert rs.permutation(large, 500, alternative="greater").first().p_value < 0.01
    assert rs.permutation(large, 500, alternative="less").first().p_value > 0.9
    same = pairs(spark, np.ones(4), np.ones(4))
    assert rs.permutation(same, 100).first().p_value == 1 and rs.permutation_large(same, "doc_id", 20).first().p_value == 1


def test_hashed_route_agrees(spark):
    df = pairs(spark, normal(3.2, 1, 300), normal(3, 1, 300, 1))
    small, large = rs.bootstrap(df, 2000).first(), rs.bootstrap_large(df, "doc_id", 400).first()
    assert large.point_estimate == pytest.approx(small.point_estimate)
    assert large.ci_upper - large.ci_lower == pytest.approx(small.ci_upper - small.ci_lower, rel=0.25)
    p, q = rs.permutation(df, 2000).first(), rs.permutation_large(df, "doc_id", 400).first()
    assert q.null_distribution_std == pytest.approx(p.null_distribution_std, rel=0.15)


def test_sensitivity(spark):
    df = pairs(spark, normal(4, 1), normal(3.5, 1, seed=1))
    trials = rs.sensitivity(df, [25, 100, 500], 20, 200, 200)
    full = df.groupBy("model_pair", "metric").agg({"score_a": "avg", "score_b": "avg"}).selectExpr("model_pair", "metric", "`avg(score_a)` - `avg(score_b)` AS full_sample_estimate")
    found = {r.sample_size: r for r in rs.coverage_band(rs.sensitivity_summary(trials, full)).collect()}
    assert found[25].mean_ci_width > found[100].mean_ci_width > found[500].mean_ci_width
    assert found[500].empirical_coverage == 1 and found[500].std_point_estimate == pytest.approx(0, abs=1e-9)
    assert all(r.n_trials == 20 and r.coverage_lower <= r.empirical_coverage <= r.coverage_upper for r in found.values())


def test_by_key_agrees_with_the_exact_draw(spark):
    df = pairs(spark, normal(3.2, 1, 300), normal(3, 1, 300, 1))
    small, large = rs.bootstrap(df, 2000).first(), rs.bootstrap_by_key(df, "doc_id", 4000).first()
    assert large.point_estimate == pytest.approx(small.point_estimate) and large.n_units_resampled == 300
    assert (large.ci_lower, large.ci_upper) == pytest.approx((small.ci_lower, small.ci_upper), abs=0.03)
    again = rs.bootstrap_by_key(df.repartition(7), "doc_id", 4000).first()
    assert (again.ci_lower, again.ci_upper) == pytest.approx((large.ci_lower, large.ci_upper))
    for way in rs.ALTERNATIVES:
        p, q = rs.permutation(df, 4000, alternative=way).first(), rs.permutation_by_key(df, "doc_id", 4000, way).first()
        assert q.null_distribution_std == pytest.approx(p.null_distribution_std, rel=0.06) and q.p_value == pytest.approx(p.p_value, abs=0.03)
        assert q.observed_statistic == pytest.approx(p.observed_statistic)
    same = pairs(spark, np.ones(4), np.ones(4))
    assert rs.permutation_by_key(same, "doc_id", 100).first().p_value == 1
    assert rs.bootstrap_by_key(same.limit(0), "doc_id", 100).count() == 0


def test_by_key_draws_clusters_whole(spark):
    rng = np.random.default_rng(3)
    docs = np.repeat(np.arange(40), 16)
    a = 3 + np.repeat(rng.normal(0, 1.5, 40), 16) + rng.normal(0, 0.2, 640)
    df = pairs(spark, a, np.full(640, 3.0), docs)
    exact, whole = rs.bootstrap(df, 4000, cluster="doc_id").first(), rs.bootstrap_by_key(df, "doc_id", 4000, cluster=True).first()
    assert whole.ci_upper - whole.ci_lower == pytest.approx(exact.ci_upper - exact.ci_lower, rel=0.1)
    assert (whole.n_units_resampled, whole.cluster_by) == (40, "doc_id")


def test_poisson_counts(spark):
    """Weights have mean and variance 1, and no two draws are alike."""
    sums = rs.draw_sums(pairs(spark, np.ones(5000), np.zeros(5000)), "doc_id", 200, "poisson", 1).toPandas()
    assert sums.weight.mean() / 5000 == pytest.approx(1, abs=0.005) and sums.weight.std() == pytest.approx(5000**0.5, rel=0.2)
    assert (sums.total == sums.weight).all() and sums.draw.nunique() == 200


def test_subsamples_are_whole_and_without_replacement(spark):
    df = pairs(spark, np.arange(50.0), np.zeros(50)).repartition(3)
    found = rs.subsamples(df, [10, 50], 30, "doc_id").toPandas().sort_values("h").groupby(["sample_size", "trial"])
    drawn = {k: v.head(k[0]).score_a for k, v in found}
    assert len(drawn) == 60 and all(v.is_unique and len(v) == k[0] for k, v in drawn.items())
    assert len({tuple(sorted(v)) for k, v in drawn.items() if k[0] == 10}) == 30
    assert set(np.concatenate([v for k, v in drawn.items() if k[0] == 10])) == set(range(50))


def test_weights_by_hex_digits(spark):
    """Weights by comparing hex digits are those by numbers; each md5 is worked out once for a row and draw."""
    words = ["00000000", *[f"{int(p * 2**32) + k:08x}" for p in rs.POISSON for k in (-1, 0, 1, 2)], "ffffffff"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(rs.poisson_weight(rs.F.col("w")), rs.reaches(rs.F.col("w"), 0.5)).collect()
    assert [tuple(r) for r in got] == [(sum(int(w, 16) / 2**32 >= p for p in rs.POISSON), int(w, 16) >= 2**31) for w in words]
    plan = rs.bootstrap_large(pairs(spark, np.ones(3), np.zeros(3)), "doc_id", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_resamples_without_rows_are_left_out(spark):
    found = rs.bootstrap_large(pairs(spark, np.ones(1), np.zeros(1)), "doc_id", 200).first()
    assert found.n_resamples == pytest.approx(200 * (1 - np.exp(-1)), abs=30) and found.ci_lower == found.ci_upper == 1


def test_pairs_of_all_dimensions_at_once(spark):
    from judge_jobs.operators import effects

    panel = spark.createDataFrame([(1, 1, 2.0, 3.0), (1, 2, 4.0, None), (2, 1, 1.0, 1.0), (None, 1, 1.0, 1.0), (None, 2, 1.0, 1.0), (3, 0, 1.0, 1.0), (4, 2, 5.0, 5.0), (4, 1, 2.0, 2.5)], "doc_id int, model_index int, x double, y double")
    long = panel.unpivot(["doc_id", "model_index"], ["x", "y"], "metric", "score")
    wide = effects.paired_dimensions(panel, 1, 2, ("x", "y"))
    assert wide.columns == effects.paired(long, 1, 2).columns
    assert sorted(map(str, wide.collect())) == sorted(map(str, effects.paired(long, 1, 2).collect())) and wide.count() == 4


def test_best_rows_without_a_sort(spark):
    from judge_jobs.operators import effects

    rows = [(2, 0, 1.0, 5.0, None), (1, 2, 3.0, 5.0, None), (1, 1, 3.0, 5.0000000001, None), (None, 0, 3.0, 5.0, None), (3, 0, None, 4.0, None)]
    panel = spark.createDataFrame(rows, "doc_id long, model_index int, x double, y double, z double").repartition(3)
    found = effects.best_rows(panel, ("x", "y", "z"))
    assert sorted(tuple(r) for r in found.collect()) == [("x", 1, 1, 3.0), ("y", 1, 1, 5.0)]
    assert effects.best_rows(panel.limit(0), ("x", "y", "z")).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "Expand" not in plan
