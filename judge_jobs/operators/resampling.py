"""Bootstrap intervals, sign-flip tests and small-sample studies for pairs of models.

Groups that fit a task go through numpy, a group for each task, in chunks of bounded size, with the exact
multinomial draw (:func:`bootstrap`, :func:`permutation`). Groups of any size use hashed weights: Poisson counts
or signs by (key, resample) give each partition one partial sum for each resample, so what moves is
resamples, not rows; draws don't depend on partitions or retries. :func:`bootstrap_by_key` and
:func:`permutation_by_key` draw them in numpy, many thousands at a time; the ``_large`` forms use md5 in built-in
functions, so that SQL engines can draw the same.
"""

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = ("model_pair", "metric")
#: Cells (rows x resamples) that a task draws at once.
CELLS = 4_000_000
#: Groups whose sums a task holds at once.
GROUPS = 64
#: Cumulative Poisson(1) probabilities for counts 0 to 7.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)

STATISTICS = ("mean_diff", "median_diff")
ALTERNATIVES = ("two-sided", "greater", "less")


def _seeded(seed: int, *key: object):
    import numpy as np

    return np.random.default_rng([seed, zlib.crc32(repr(key).encode())])


def _bootstrap(a, b, n_resamples: int, statistic: str, rng, sums=None):
    """Resampled statistics. ``sums``: (sum a, sum b, rows) by cluster for cluster means."""
    import numpy as np

    n = len(a) if sums is None else len(sums[0])
    out = np.empty(n_resamples)
    step = max(1, CELLS // max(1, n))
    for at in range(0, n_resamples, step):
        idx = rng.integers(0, n, size=(min(step, n_resamples - at), n))
        if sums is not None:
            sa, sb, m = (s[idx].sum(axis=1) for s in sums)
            out[at : at + len(idx)] = (sa - sb) / m
        elif statistic == "mean_diff":
            out[at : at + len(idx)] = a[idx].mean(axis=1) - b[idx].mean(axis=1)
        else:
            out[at : at + len(idx)] = np.median(a[idx], axis=1) - np.median(b[idx], axis=1)
    return out


def _flips(diffs, n_permutations: int, statistic: str, rng):
    import numpy as np

    out = np.empty(n_permutations)
    step = max(1, CELLS // max(1, len(diffs)))
    for at in range(0, n_permutations, step):
        signs = rng.integers(0, 2, size=(min(step, n_permutations - at), len(diffs)), dtype=np.int8) * 2.0 - 1
        moved = signs * diffs
        out[at : at + len(signs)] = moved.mean(axis=1) if statistic == "mean_diff" else np.median(moved, axis=1)
    return out


def _p_value(null, observed: float, alternative: str) -> float:
    """Share of the null at least as extreme; equal up to rounding counts."""
    import numpy as np

    slack = 1e-12 * max(1.0, abs(observed))
    if alternative == "two-sided":
        return float(np.mean(np.abs(null) >= abs(observed) - slack))
    return float(np.mean(null >= observed - slack) if alternative == "greater" else np.mean(null <= observed + slack))


def bootstrap(pairs: DataFrame, n_resamples: int = 10_000, ci_level: float = 0.95, statistic: str = "mean_diff", cluster: str | None = None, seed: int = 42, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Percentile interval of the difference for each group of ``pairs`` (by, score_a, score_b, and the cluster column)."""
    if statistic not in STATISTICS:
        raise ValueError(f"unsupported statistic: {statistic}")
    if cluster and cluster not in pairs.columns:
        raise ValueError(f"no column {cluster} to resample by")

    def run(key, rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values([c for c in rows.columns if c not in by], kind="stable")
        a, b = rows["score_a"].to_numpy(float), rows["score_b"].to_numpy(float)
        rng, sums, n = _seeded(seed, *key), None, len(a)
        if cluster:
            g = rows.assign(n=1).groupby(cluster)[["score_a", "score_b", "n"]].sum()
            n = len(g)
            if statistic == "mean_diff":
                sums = [g[c].to_numpy(float) for c in ("score_a", "score_b", "n")]
        if cluster and sums is None:
            members = [np.flatnonzero(rows[cluster].to_numpy() == c) for c in np.unique(rows[cluster].to_numpy())]
            draws = [np.concatenate([members[k] for k in rng.integers(0, n, n)]) for _ in range(n_resamples)]
            stats = np.array([np.median(a[i]) - np.median(b[i]) for i in draws])
        else:
            stats = _bootstrap(a, b, n_resamples, statistic, rng, sums)
        point = a.mean() - b.mean() if statistic == "mean_diff" else np.median(a) - np.median(b)
        tail = 50 * (1 - ci_level)
        return pd.DataFrame([[*key, float(point), float(np.percentile(stats, tail)), float(np.percentile(stats, 100 - tail)), n_resamples, cluster, n]], columns=[*by, "point_estimate", "ci_lower", "ci_upper", "n_resamples", "cluster_by", "n_units_resampled"])

    schema = ", ".join(f"{c} string" for c in by) + ", point_estimate double, ci_lower double, ci_upper double, n_resamples int, cluster_by string, n_units_resampled long"
    return pairs.withColumns({c: F.col(c).cast("string") for c in by}).groupBy(*by).applyInPandas(run, schema)


def permutation(pairs: DataFrame, n_permutations: int = 10_000, statistic: str = "mean_diff", alternative: str = "two-sided", seed: int = 42, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Sign-flip test of score_a - score_b for each group."""
    if statistic not in STATISTICS or alternative not in ALTERNATIVES:
        raise ValueError(f"unsupported statistic or alternative: {statistic}, {alternative}")

    def run(key, rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values([c for c in rows.columns if c not in by], kind="stable")
        diffs = rows["score_a"].to_numpy(float) - rows["score_b"].to_numpy(float)
        observed = float(diffs.mean() if statistic == "mean_diff" else np.median(diffs))
        null = _flips(diffs, n_permutations, statistic, _seeded(seed, *key))
        return pd.DataFrame([[*key, observed, _p_value(null, observed, alternative), n_permutations, float(null.std())]], columns=[*by, "observed_statistic", "p_value", "n_permutations", "null_distribution_std"])

    schema = ", ".join(f"{c} string" for c in by) + ", observed_statistic double, p_value double, n_permutations int, null_distribution_std double"
    return pairs.withColumns({c: F.col(c).cast("string") for c in by}).groupBy(*by).applyInPandas(run, schema)


def draw_word(seed: int, *keys: Column) -> Column:
    """The first eight hex digits of the md5 of the keys: a uniform number in [0, 1), times 2^32 (the same in SQL engines that have md5)."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 8)


def reaches(word: Column, share: float) -> Column:
    """Whether the number is at least ``share`` (in [0, 1)): hex digits of one length are ordered as their numbers are."""
    return word >= F.lit(f"{math.ceil(share * 2**32):08x}")


def poisson_weight(word: Column) -> Column:
    out = F.lit(0)
    for p in POISSON:
        out = out + reaches(word, p).cast("int")
    return out


def bootstrap_large(pairs: DataFrame, key: str, n_resamples: int, ci_level: float = 0.95, seed: int = 42, by: tuple[str, ...] = GROUP) -> DataFrame:
    """As :func:`bootstrap` of means for groups of any size, by Poisson weights: partial sums by resample are what is shuffled.

    The number of rows drawn varies around n, an approximation of order 1/n (method: poisson). Resamples that draw no row are left out.
    """
    word = draw_word(seed, F.col(key), F.col("draw"))
    # no filter by weight: it would work out the weight, and the md5 for each of its terms, once more
    drawn = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1)))).withColumn("word", word).withColumn("w", poisson_weight(F.col("word")))
    sums = drawn.groupBy(*by, "draw").agg(F.sum(F.col("w") * (F.col("score_a") - F.col("score_b"))).alias("total"), F.sum("w").alias("weight"))
    sums = sums.where("weight > 0").select(*by, (F.col("total") / F.col("weight")).alias("stat"))
    tail = (1 - ci_level) / 2
    bounds = sums.groupBy(*by).agg(F.percentile("stat", [tail, 1 - tail]).alias("ci"), F.count("*").alias("n_resamples"))
    point = pairs.groupBy(*by).agg((F.avg("score_a") - F.avg("score_b")).alias("point_estimate"), F.count("*").alias("n_units_resampled"))
    return point.join(bounds, list(by)).select(*by, "point_estimate", F.col("ci")[0].alias("ci_lower"), F.col("ci")[1].alias("ci_upper"), "n_resamples", "n_units_resampled", F.lit("poisson").alias("method"))


def permutation_large(pairs: DataFrame, key: str, n_permutations: int, seed: int = 42, by: tuple[str, ...] = GROUP) -> DataFrame:
    """As :func:`permutation` of means (two-sided) for groups of any size, by hashed signs: the exact law."""
    d = F.col("score_a") - F.col("score_b")
    flipped = pairs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1)))).withColumn("s", F.when(reaches(draw_word(seed, F.col(key), F.col("draw")), 0.5), 1.0).otherwise(-1.0))
    null = flipped.groupBy(*by, "draw").agg(F.avg(F.col("s") * d).alias("stat"))
    observed = pairs.groupBy(*by).agg(F.avg(d).alias("observed_statistic"))
    both = null.join(observed, list(by))
    slack = 1e-12 * F.greatest(F.lit(1.0), F.abs("observed_statistic"))
    return both.groupBy(*by).agg(F.first("observed_statistic").alias("observed_statistic"), F.avg((F.abs("stat") >= F.abs("observed_statistic") - slack).cast("double")).alias("p_value"), F.count("*").alias("n_permutations"), F.stddev_pop("stat").alias("null_distribution_std"))


def _mixed(keys, draws):
    """64-bit hashes of all (key, draw): a row for each key."""
    import numpy as np

    x = keys[:, None] + draws[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _seed_key(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def draw_sums(pairs: DataFrame, key: str, draws: int, kind: str, seed: int, by: tuple[str, ...] = GROUP) -> DataFrame:
    """by, draw, total (of weight x (score_a - score_b)) and weight: partial sums of each partition, added up.

    ``kind``: ``poisson`` counts, or ``sign`` for +1 and -1. Rows with one key share their draws.
    """
    names = [*by, "draw", "total", "weight"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = 20
        table = np.searchsorted(np.array(POISSON), (np.arange(1 << bits) + 0.5) / (1 << bits), side="right").astype(np.float64)
        number = np.arange(draws, dtype=np.uint64)
        sums: dict[tuple, np.ndarray] = {}

        def rows():
            for group, total in sums.items():
                yield pa.RecordBatch.from_arrays([*[pa.array([g] * draws, pa.string()) for g in group], pa.array(np.arange(draws, dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=names)

        for batch in batches:
            frame = batch.to_pandas()
            for group, part in frame.groupby(list(by), dropna=False, sort=False):
                group = tuple(None if g != g else g for g in group)
                if group not in sums and len(sums) >= GROUPS:
                    yield from rows()
                    sums.clear()
                total = sums.setdefault(group, np.zeros((draws, 2)))
                keys, values = part["_key"].to_numpy().view(np.uint64), np.stack([part["_d"].to_numpy(float), np.ones(len(part))], axis=1)
                step = 64 * max(1, CELLS // len(keys) // 64)
                for a in range(0, draws, step):
                    if kind == "poisson":
                        total[a : a + step] += table[_mixed(keys, number[a : a + step]) >> np.uint64(64 - bits)].T @ values
                    else:
                        # a hash has the signs of 64 draws
                        words = _mixed(keys, np.arange(a // 64, -(-min(a + step, draws) // 64), dtype=np.uint64))
                        plus = np.unpackbits(words.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little", count=min(step, draws - a))
                        total[a : a + step, 0] += 2 * (values[:, 0] @ plus) - values[:, 0].sum()
                        total[a : a + step, 1] += len(keys)
        yield from rows()

    keyed = pairs.select(*[F.col(c).cast("string").alias(c) for c in by], _seed_key(seed, key).alias("_key"), (F.col("score_a") - F.col("score_b")).cast("double").alias("_d"))
    parts = keyed.mapInArrow(run, ", ".join(f"{c} string" for c in by) + ", draw int, total double, weight double")
    return parts.groupBy(*by, "draw").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def bootstrap_by_key(pairs: DataFrame, key: str, n_resamples: int = 10_000, ci_level: float = 0.95, cluster: bool = False, seed: int = 42, by: tuple[str, ...] = GROUP) -> DataFrame:
    """As :func:`bootstrap` of means, for groups of any size. ``key`` names a row, or (``cluster``) what is drawn whole.

    Resamples whose weights are all zero (tiny groups) have no mean and are left out of n_resamples.
    """
    tail = (1 - ci_level) / 2
    drawn = draw_sums(pairs, key, n_resamples, "poisson", seed, by).where("weight > 0").withColumn("stat", F.col("total") / F.col("weight"))
    bounds = drawn.groupBy(*by).agg(F.percentile("stat", [tail, 1 - tail]).alias("ci"), F.count("*").cast("int").alias("n_resamples"))
    rows = pairs.withColumns({c: F.col(c).cast("string") for c in by})
    units = F.count_distinct(key) if cluster else F.count("*")
    point = rows.groupBy(*by).agg(F.avg(F.col("score_a") - F.col("score_b")).alias("point_estimate"), units.alias("n_units_resampled"))
    return point.join(bounds, list(by)).select(*by, "point_estimate", F.col("ci")[0].alias("ci_lower"), F.col("ci")[1].alias("ci_upper"), "n_resamples", F.lit(key if cluster else None).cast("string").alias("cluster_by"), "n_units_resampled")


def permutation_by_key(pairs: DataFrame, key: str, n_permutations: int = 10_000, alternative: str = "two-sided", seed: int = 42, by: tuple[str, ...] = GROUP) -> DataFrame:
    """As :func:`permutation` of means, for groups of any size, with one sign for each key."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"unsupported alternative: {alternative}")
    null = draw_sums(pairs, key, n_permutations, "sign", seed, by).select(*by, (F.col("total") / F.col("weight")).alias("stat"))
    return null_summary(null, pairs, alternative, by)


def null_summary(null: DataFrame, pairs: DataFrame, alternative: str, by: tuple[str, ...] = GROUP) -> DataFrame:
    """The test's figures by group. ``null``: by, stat, a row for each permutation."""
    observed = pairs.groupBy(*[F.col(c).cast("string").alias(c) for c in by]).agg(F.avg(F.col("score_a") - F.col("score_b")).alias("observed_statistic"))
    seen, slack = F.col("observed_statistic"), 1e-9 * F.greatest(F.lit(1.0), F.abs("observed_statistic"))
    extreme = {"two-sided": F.abs("stat") >= F.abs(seen) - slack, "greater": F.col("stat") >= seen - slack, "less": F.col("stat") <= seen + slack}[alternative]
    return null.join(observed, list(by)).groupBy(*by, "observed_statistic").agg(F.avg(extreme.cast("double")).alias("p_value"), F.count("*").cast("int").alias("n_permutations"), F.stddev_pop("stat").alias("null_distribution_std"))


def subsamples(pairs: DataFrame, sizes: list[int], n_trials: int, key: str, seed: int = 42, by: tuple[str, ...] = GROUP) -> DataFrame:
    """by, sample_size, trial, h, score_a, score_b: for each trial, the rows of each partition with the smallest hashes.

    The ``sample_size`` smallest of a trial over all partitions are a sample of the group without replacement.
    """
    names = [*by, "sample_size", "trial", "h", "score_a", "score_b"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        least: dict[tuple, tuple] = {}

        def rows(group, size):
            h, a, b = least.pop((group, size))
            k = len(h)
            arrays = [*[pa.array([g] * (k * n_trials), pa.string()) for g in group], pa.array(np.full(k * n_trials, size, np.int32)), pa.array(np.tile(np.arange(n_trials, dtype=np.int32), k)), pa.array((h >> np.uint64(1)).astype(np.int64).ravel()), pa.array(a.ravel()), pa.array(b.ravel())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for group, part in batch.to_pandas().groupby(list(by), dropna=False, sort=False):
                group = tuple(None if g != g else g for g in group)
                keys, x, y = part["_key"].to_numpy().view(np.uint64), part["score_a"].to_numpy(float), part["score_b"].to_numpy(float)
                step = max(1, CELLS // n_trials)
                for n, size in enumerate(sizes):
                    if (group, size) not in least and len(least) >= GROUPS:
                        yield rows(*next(iter(least)))
                    number = np.arange(n * n_trials, (n + 1) * n_trials, dtype=np.uint64)
                    for c in range(0, len(keys), step):
                        h = _mixed(keys[c : c + step], number)
                        a, b = (np.broadcast_to(v[c : c + step, None], h.shape) for v in (x, y))
                        if (group, size) in least:
                            h, a, b = (np.concatenate(z) for z in zip(least[group, size], (h, a, b)))
                        if len(h) > size:
                            at = np.argpartition(h, size - 1, axis=0)[:size]
                            h, a, b = (np.take_along_axis(z, at, axis=0) for z in (h, a, b))
                        least[group, size] = h, a, b
        for group, size in list(least):
            yield rows(group, size)

    keyed = pairs.select(*[F.col(c).cast("string").alias(c) for c in by], _seed_key(seed, key, "score_a", "score_b").alias("_key"), F.col("score_a").cast("double").alias("score_a"), F.col("score_b").cast("double").alias("score_b"))
    return keyed.mapInArrow(run, ", ".join(f"{c} string" for c in by) + ", sample_size int, trial int, h long, score_a double, score_b double")


def sensitivity(pairs: DataFrame, sizes: list[int], n_trials: int = 500, n_resamples: int = 2000, n_permutations: int = 2000, ci_level: float = 0.95, seed: int = 42, by: tuple[str, ...] = GROUP, key: str = "doc_id") -> DataFrame:
    """Intervals and tests on random subsamples: a row for each group, size and trial.

    A task gets one trial's sample, never a group's rows. A size over a group's rows fails the job.
    """
    names = [*by, "sample_size", "trial", "point_estimate", "ci_lower", "ci_upper", "p_value"]

    def run(at, rows):
        import numpy as np
        import pandas as pd

        size = at[-2]
        if size > len(rows):
            raise ValueError(f"sample_size {size} exceeds full dataset size {len(rows)}")
        rows = rows.sort_values(["h", "score_a", "score_b"]).head(size)
        x, y = rows["score_a"].to_numpy(), rows["score_b"].to_numpy()
        rng = _seeded(seed, *at)
        stats = _bootstrap(x, y, n_resamples, "mean_diff", rng)
        tail = 50 * (1 - ci_level)
        p = _p_value(_flips(x - y, n_permutations, "mean_diff", rng), float((x - y).mean()), "two-sided")
        return pd.DataFrame([[*at, float(x.mean() - y.mean()), float(np.percentile(stats, tail)), float(np.percentile(stats, 100 - tail)), p]], columns=names)

    schema = ", ".join(f"{c} string" for c in by) + ", sample_size int, trial int, point_estimate double, ci_lower double, ci_upper double, p_value double"
    trials = subsamples(pairs, sizes, n_trials, key, seed, by).groupBy(*by, "sample_size", "trial").applyInPandas(run, schema)
    full = pairs.groupBy(*[F.col(c).cast("string").alias(c) for c in by]).agg((F.avg("score_a") - F.avg("score_b")).alias("_full"))
    inside, p = F.col("_full").between(F.col("ci_lower"), F.col("ci_upper")), F.col("p_value")
    return trials.join(full, list(by)).select(*names[:-1], (F.col("ci_upper") - F.col("ci_lower")).alias("ci_width"), inside.alias("contains_full_sample_estimate"), p, (p < 0.05).alias("significant_at_05"))


def sensitivity_summary(trials: DataFrame, full: DataFrame, ci_level: float = 0.95, by: tuple[str, ...] = GROUP) -> DataFrame:
    """By group and size: widths, coverage with its standard error, significance. ``full``: by, full_sample_estimate."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    out = trials.groupBy(*by, "sample_size").agg(
        F.count("trial").alias("n_trials"), F.avg("ci_width").alias("mean_ci_width"), F.stddev_samp("ci_width").alias("std_ci_width"), share("contains_full_sample_estimate").alias("empirical_coverage"),
        F.avg("point_estimate").alias("mean_point_estimate"), F.stddev_samp("point_estimate").alias("std_point_estimate"), share("significant_at_05").alias("fraction_significant"), F.median("p_value").alias("median_p_value"),
    )
    p = F.col("empirical_coverage")
    return out.join(full, list(by)).withColumns({"coverage_se": F.sqrt(p * (1 - p) / F.col("n_trials")), "nominal_ci_level": F.lit(ci_level)})


def coverage_band(summary: DataFrame) -> DataFrame:
    """Add the 95 % band of the coverage and whether the nominal level lies in it."""
    p, se = F.col("empirical_coverage"), F.col("coverage_se")
    low, high = p - 1.96 * se, p + 1.96 * se
    return summary.withColumns({"coverage_lower": low, "coverage_upper": high, "nominal_in_band": F.col("nominal_ci_level").between(low, high)})
