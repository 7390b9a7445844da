import numpy as np
import pandas as pd
import pytest
from judge_jobs.operators import exact_draws as ed
from judge_jobs.operators import resampling as rs


def pairs(spark, a, b, docs=None, name="p"):
    docs = range(len(a)) if docs is None else docs
    return spark.createDataFrame(pd.DataFrame({"model_pair": name, "metric": "m", "doc_id": [str(d) for d in docs], "score_a": a, "score_b": b}))


def normal(mean, sd, n=500, seed=0):
    return np.random.default_rng(seed).normal(mean, sd, n)


def test_every_resample_has_exactly_n_draws():
    """Counts of the leaves, drawn by different tasks, add up to n in each resample and vary like a multinomial's."""
    sizes = np.array([5, 0, 40, 7, 3, 3, 100, 42])
    upto = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.stack([ed.leaf_draws(1, ("g",), leaf, 3, upto, 4000) for leaf in range(8) if sizes[leaf]])
    share = sizes[sizes > 0] / 200
    assert (counts.sum(axis=0) == 200).all() and (counts >= 0).all()
    assert counts.mean(axis=1) == pytest.approx(200 * share, rel=0.05)
    assert counts.var(axis=1) == pytest.approx(200 * share * (1 - share), rel=0.12)
    for a, w in ed.uniform_weights(1, ("g",), 3, counts[2], 7):
        assert (w.sum(axis=1) == counts[2][a : a + len(w)]).all()
    memo = {}
    again = np.stack([ed.leaf_draws(1, ("g",), leaf, 3, upto, 4000, memo) for leaf in range(8) if sizes[leaf]])
    assert (again == counts).all()


def test_means_agree_with_one_task(spark, monkeypatch):
    monkeypatch.setattr(ed, "LEAF", 50)
    df = pairs(spark, normal(3.2, 1, 400), normal(3, 1, 400, 1))
    small, large = rs.bootstrap(df, 4000).first(), ed.bootstrap_exact(df, "doc_id", 4000).first()
    assert large.point_estimate == pytest.approx(small.point_estimate) and (large.n_units_resampled, large.n_resamples) == (400, 4000)
    assert (large.ci_lower, large.ci_upper) == pytest.approx((small.ci_lower, small.ci_upper), abs=0.03)
    again = ed.bootstrap_exact(df.repartition(7), "doc_id", 4000).first()
    assert (again.ci_lower, again.ci_upper) == pytest.approx((large.ci_lower, large.ci_upper))
    constant = pairs(spark, np.ones(300), np.zeros(300))
    row = ed.bootstrap_exact(constant, "doc_id", 50).first()
    assert (row.ci_lower, row.point_estimate, row.ci_upper) == (1, 1, 1)


def test_clusters_are_drawn_whole(spark, monkeypatch):
    monkeypatch.setattr(ed, "LEAF", 8)
    rng = np.random.default_rng(3)
    docs = np.repeat(np.arange(40), 16)
    a = 3 + np.repeat(rng.normal(0, 1.5, 40), 16) + rng.normal(0, 0.2, 640)
    df = pairs(spark, a, np.full(640, 3.0), docs)
    exact, whole = rs.bootstrap(df, 4000, cluster="doc_id").first(), ed.bootstrap_exact(df, "doc_id", 4000, cluster=True).first()
    assert whole.ci_upper - whole.ci_lower == pytest.approx(exact.ci_upper - exact.ci_lower, rel=0.1)
    assert (whole.n_units_resampled, whole.cluster_by) == (40, "doc_id")
    exact = rs.bootstrap(df, 1000, cluster="doc_id", statistic="median_diff").first()
    whole = ed.median_bootstrap(df, "doc_id", 2000, cluster=True).first()
    assert whole.point_estimate == pytest.approx(exact.point_estimate) and whole.n_units_resampled == 40
    assert (whole.ci_lower, whole.ci_upper) == pytest.approx((exact.ci_lower, exact.ci_upper), abs=0.35)


@pytest.mark.parametrize("kind", ["continuous", "whole", "few", "one"])
def test_median_intervals_agree_with_one_task(spark, kind):
    n = {"few": 9, "one": 1}.get(kind, 601)
    a, b = normal(3.4, 1, n), normal(3, 1, n, 1)
    if kind == "whole":
        a, b = np.rint(2 * a) / 2, np.rint(2 * b) / 2
    df = pairs(spark, a, b)
    small, large = rs.bootstrap(df, 4000, statistic="median_diff").first(), ed.median_bootstrap(df, "doc_id", 4000).first()
    assert large.point_estimate == pytest.approx(small.point_estimate) and large.n_units_resampled == n and large.n_resamples == 4000
    assert (large.ci_lower, large.ci_upper) == pytest.approx((small.ci_lower, small.ci_upper), abs=0.06)
    if kind == "continuous":
        assert ed.median_bootstrap(df.repartition(5), "doc_id", 4000).first() == large


def test_narrow_windows_are_widened(spark):
    """A first window that is too narrow changes no law; whole clusters draw the very same."""
    df = pairs(spark, normal(3.4, 1, 300), normal(3, 1, 300, 1)).union(pairs(spark, np.arange(40.0), np.zeros(40), name="q"))
    wide, narrow = (sorted(ed.median_bootstrap(df, "doc_id", 200, cluster=True, reach=r).collect()) for r in (1000.0, 0.5))
    assert wide == narrow and len(wide) == 2
    wide, narrow = (sorted(ed.median_bootstrap(df, "doc_id", 4000, reach=r).collect()) for r in (1000.0, 0.5))
    for x, y in zip(wide, narrow, strict=True):
        assert x.point_estimate == y.point_estimate and (x.ci_lower, x.ci_upper) == pytest.approx((y.ci_lower, y.ci_upper), abs=1 if x.model_pair == "q" else 0.05)


def test_medians_of_classes_by_hand():
    """Medians of weights over classes against numpy on the rows drawn, outside the window too."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        values = np.sort(rng.integers(0, 12, rng.integers(1, 30))).astype(float)
        low, high = np.sort(rng.integers(-1, 14, 2))
        w = rng.multinomial(len(values), np.full(len(values), 1 / len(values)), size=1)
        at = np.unique(values[(values >= low) & (values <= high)])
        weights = np.stack([w[:, values == v].sum(axis=1) for v in at], axis=1) if len(at) else np.zeros((1, 0), int)
        got = ed._median(np.array([w.sum()]), w[:, values < low].sum(axis=1), weights, at)[0]
        drawn = np.repeat(values, w[0])
        middle = drawn[[(len(drawn) - 1) // 2, len(drawn) // 2]]
        if low <= middle[0] and middle[1] <= high:
            assert got == middle.mean() == np.median(drawn)
        else:
            assert np.isnan(got)


def test_cluster_medians_by_hand(spark):
    """Each draw's median of whole clusters against numpy on the rows that its weights draw."""
    docs = np.repeat(np.arange(30), 5)
    a, b = np.rint(normal(3, 1, 150) * 3) / 3, normal(3, 1, 150, 1)
    df = pairs(spark, a, b, docs)
    rows = df.selectExpr("model_pair", "metric", "doc_id AS unit", "score_a AS a", "score_b AS b", "2 AS ka", "2 AS kb", "1 AS c").withColumn("h", rs._seed_key(42, "unit"))
    placed, shape = ed.leaved(rows, rs.GROUP, "unit")
    found = ed._draw_medians(ed._cluster_parts(rows, 150, 42, rs.GROUP), rs.GROUP).toPandas()
    own = placed.toPandas().sort_values(["leaf", "h", "unit"])
    unit = pd.factorize(own["unit"])[0]
    counts = ed.leaf_draws(42, ("p", "m"), 0, *shape["p", "m"], 150)
    assert shape["p", "m"][1][-1] == 30 and (counts == 30).all()
    weights = np.concatenate([w for _, w in ed.uniform_weights(42, ("p", "m"), 0, counts, 30)])
    assert (weights.sum(axis=1) == 30).all()
    for side in "ab":
        want = [np.median(np.repeat(own[side].to_numpy(), w[unit])) for w in weights]
        assert found[found.side == side].sort_values("draw")["median"].to_numpy() == pytest.approx(np.array(want))


@pytest.mark.parametrize("kind", ["continuous", "whole", "even", "equal"])
def test_median_permutation(spark, kind):
    n = 400 if kind == "even" else 301
    a, b = normal(3.2, 1, n), normal(3, 1, n, 1)
    if kind == "whole":
        a, b = np.rint(a), np.rint(b)
    if kind == "equal":
        a = b = np.ones(n)
    df = pairs(spark, a, b)
    for way in rs.ALTERNATIVES if kind == "even" else ("two-sided",):
        p, q = rs.permutation(df, 4000, "median_diff", way).first(), ed.median_permutation(df, 4000, way).first()
        assert q.observed_statistic == pytest.approx(p.observed_statistic) and q.n_permutations == 4000
        assert q.p_value == pytest.approx(p.p_value, abs=0.035) and q.null_distribution_std == pytest.approx(p.null_distribution_std, rel=0.08, abs=1e-9)
    with pytest.raises(ValueError):
        ed.median_permutation(df, 10, "other")


def test_no_group_in_one_task(spark):
    """No window, median or percentile over rows: what is gathered by group are draws and the values of a window."""
    df = pairs(spark, normal(3, 1, 50), normal(3, 1, 50, 1))
    rows = df.selectExpr("model_pair", "metric", "score_a AS a", "score_b AS b")
    ends = ed.windows(rows, ("a", "b"), ed.F.count("*"), 4.0, rs.GROUP)
    plan = ed.own_medians(rows, ends, "a", rs.GROUP)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate", plan.index("Window"))  # over counted values only


def test_empty_and_null_groups(spark):
    df = pairs(spark, np.ones(4), np.zeros(4))
    assert ed.bootstrap_exact(df.limit(0), "doc_id", 10).count() == 0
    assert ed.median_bootstrap(df.limit(0), "doc_id", 10).count() == 0
    assert ed.median_permutation(df.limit(0), 10).count() == 0
    nulls = df.withColumn("metric", ed.F.lit(None).cast("string")).withColumn("doc_id", ed.F.lit(None).cast("string"))
    assert ed.bootstrap_exact(nulls, "doc_id", 10).first().ci_lower == 1
    assert ed.median_bootstrap(nulls, "doc_id", 10, cluster=True).first().n_units_resampled == 1
    assert ed.median_permutation(nulls, 10).first().observed_statistic == 1


def scale(spark, n, docs=None, name="p"):
    """Scores on a scale of thirds: few classes of equal differences."""
    return pairs(spark, np.rint(normal(3.2, 1, n) * 3) / 3, np.rint(normal(3, 1, n, 1) * 3) / 3, docs, name)


@pytest.mark.parametrize("leaf", [4096, 4])
def test_resamples_over_counts_of_equal_values(spark, monkeypatch, leaf):
    """The law is that of one task, for rows and for whole clusters, and of units drawn one by one."""
    monkeypatch.setattr(ed, "LEAF", leaf)
    for df, cluster in ((scale(spark, 600), False), (scale(spark, 600, np.arange(600) // 2), True)):
        small = rs.bootstrap(df, 4000, cluster="doc_id" if cluster else None).first()
        large = ed.bootstrap_exact(df, "doc_id", 4000, cluster=cluster).first()
        assert large.point_estimate == pytest.approx(small.point_estimate) and large.n_units_resampled == small.n_units_resampled and large.cluster_by == small.cluster_by
        assert (large.ci_lower, large.ci_upper) == pytest.approx((small.ci_lower, small.ci_upper), abs=0.02)
        monkeypatch.setattr(ed, "CLASSES", 3)  # more classes are drawn unit by unit
        each = ed.bootstrap_exact(df, "doc_id", 4000, cluster=cluster).first()
        monkeypatch.setattr(ed, "CLASSES", 100_000)
        assert each.point_estimate == pytest.approx(large.point_estimate) and each.n_units_resampled == large.n_units_resampled
        assert (each.ci_lower, each.ci_upper) == pytest.approx((large.ci_lower, large.ci_upper), abs=0.02)


def test_class_draws_are_multinomial():
    units = np.array([5, 1, 0, 40, 7])
    counts = np.full(6000, 60)
    drawn = np.concatenate([w for _, w in ed.class_draws(1, ("g",), 2, counts, units)])
    share = units / units.sum()
    assert (drawn.sum(axis=1) == counts).all() and (drawn[:, 2] == 0).all()
    assert drawn.mean(axis=0) == pytest.approx(60 * share, rel=0.05) and drawn.var(axis=0) == pytest.approx(60 * share * (1 - share), rel=0.1)
    values = np.array([1.0, np.nan, np.nan, 2.0, 3.0])
    assert (np.isnan(ed._weighed(drawn, values)) == (drawn[:, 1] > 0)).all()


def test_sign_flips_over_counts_of_equal_sizes(spark, monkeypatch):
    df = scale(spark, 500)
    for way in rs.ALTERNATIVES:
        p, q = rs.permutation(df, 4000, alternative=way).first(), ed.permutation_exact(df, "doc_id", 4000, way).first()
        assert q.observed_statistic == pytest.approx(p.observed_statistic) and q.n_permutations == 4000
        assert q.null_distribution_std == pytest.approx(p.null_distribution_std, rel=0.05) and q.p_value == pytest.approx(p.p_value, abs=0.03)
    whole = scale(spark, 600, np.arange(600) // 3)
    q = ed.permutation_exact(whole, "doc_id", 4000).first()
    d = whole.selectExpr("doc_id", "score_a - score_b AS d").groupBy("doc_id").sum("d").toPandas()["sum(d)"].to_numpy()
    assert q.null_distribution_std == pytest.approx((d**2).sum() ** 0.5 / 600, rel=0.05)
    monkeypatch.setattr(ed, "CLASSES", 3)  # more classes: row by row
    assert ed.permutation_exact(whole, "doc_id", 4000).first().null_distribution_std == pytest.approx(q.null_distribution_std, rel=0.06)
    assert ed.permutation_exact(df.limit(0), "doc_id", 10).count() == 0
    with pytest.raises(ValueError):
        ed.permutation_exact(df, "doc_id", 10, "other")


def test_signs_are_even_and_unlike(spark):
    """Signs of 300 draws, some of one hash each: even for every key, and unlike by key and by draw."""
    d = np.zeros((60, 300))
    for k in range(3):
        rows = spark.createDataFrame(pd.DataFrame({"model_pair": "p", "metric": [str(i) for i in range(20)], "doc_id": [f"{k}-{i}" for i in range(20)], "score_a": 1.0, "score_b": 0.0}))
        got = rs.draw_sums(rows, "doc_id", 300, "sign", 1).toPandas()
        assert set(got.total) == {-1.0, 1.0} and (got.weight == 1).all()
        d[20 * k : 20 * k + 20] = got.pivot(index="metric", columns="draw", values="total").to_numpy()
    assert abs(d.mean()) < 0.03 and np.abs(d.mean(axis=1)).max() < 0.3
    assert np.abs(np.corrcoef(d)[~np.eye(60, dtype=bool)]).max() < 0.35 and np.unique(d.T, axis=0).shape[0] == 300
