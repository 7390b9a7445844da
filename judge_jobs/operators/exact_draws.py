"""Exact bootstrap draws, and medians of resamples, for groups of any size.

Multinomial counts without a group in one task: units are dealt to leaves by the leading bits of a hash of their key.
A resample's n draws are split over the leaves from the top down, each split a binomial draw seeded by its place in the tree, so
that every task that needs a split draws the same one; within its leaf a task draws uniformly. Every resample has
exactly n draws, and no draw depends on partitions or retries.

Units of equal values are exchangeable. Where a table has few values (scores on a scale), they are counted once, and a resample is drawn over
the counts: multinomial ones for a bootstrap, binomial ones for sign flips. The law is the same, and what is drawn doesn't grow with the rows.

Medians: a resample's median stays near the group's own, so a window of values around that is enough. Rows below it, above it, or
at one value in it are exchangeable, so counting them is all that a pass over the group does: how many of a resample's draws
fall to each such class is multinomial (of sign flips: binomial), and the order statistics follow. Where whole clusters are drawn, their units go to
leaves as above and partitions add up the classes' weights. If any draw's median lies outside its window, the window is
widened and all is drawn again (the first one reaches eight standard deviations, so that this doesn't tell on the law). Some
16 sqrt(n) values move, not the group.
"""

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .resampling import ALTERNATIVES, CELLS, GROUP, GROUPS, _seed_key, null_summary, permutation_by_key
from .small import sent_if_small

#: Units that a leaf should have, and the bits of the deepest tree (the driver holds up to 2^bits counts for each group).
LEAF = 4096
MOST_BITS = 16
#: Units that a task draws at once.
DRAWN = 1_000_000
#: Draws whose weights travel together.
BLOCK = 100
#: Values of a window that a task adds up at once for one group (each holds a number for every draw).
VALUES = 128
#: Classes of equal values (of all groups) up to which resamples are drawn over their counts, and not over the units. They are fetched once, so that float sums,
#: which depend on the order of their rows, are the same in all that follows.
CLASSES = 100_000
#: Half the first window's share of the ranks, in units of 1 / sqrt(n).
REACH = 4.0


def _text(by) -> dict[str, Column]:
    return {c: F.col(c).cast("string") for c in by}


def _named(group) -> tuple:
    return tuple(None if g is None or g != g else g for g in group)


def leaf_draws(seed: int, group: tuple, leaf: int, bits: int, upto, draws: int, memo: dict | None = None):
    """How many draws of each resample fall to a leaf. ``upto``: units before each leaf, and of all."""
    import numpy as np

    memo = {} if memo is None else memo
    name = zlib.crc32(repr(group).encode())
    counts = np.full(draws, upto[-1], dtype=np.int64)
    for level in range(bits):
        node, half = leaf >> (bits - level), 1 << (bits - level - 1)
        a, middle, b = (int(upto[k]) for k in (2 * node * half, 2 * node * half + half, 2 * node * half + 2 * half))
        if memo.get(level, (None,))[0] != (group, node):
            left = np.random.default_rng([seed, name, level, node]).binomial(counts, (middle - a) / (b - a))
            memo[level] = (group, node), left, counts - left
        counts = memo[level][1 + (leaf >> (bits - level - 1)) % 2]
    return counts


def uniform_draws(seed: int, group: tuple, leaf: int, counts, units: int):
    """(first draw, counts, units drawn) of one leaf, a block of draws of bounded size after another."""
    import numpy as np

    rng = np.random.default_rng([seed, zlib.crc32(repr(group).encode()), 1 << 20, leaf])
    step = max(1, DRAWN // max(1, units))
    kind = np.uint16 if units <= 1 << 16 else np.uint32
    for a in range(0, len(counts), step):
        c = counts[a : a + step]
        yield a, c, rng.integers(0, units, size=int(c.sum()), dtype=kind)


def uniform_weights(seed: int, group: tuple, leaf: int, counts, units: int):
    """As :func:`uniform_draws`, as (first draw, how often each unit is drawn: draws x units)."""
    import numpy as np

    for a, c, drawn in uniform_draws(seed, group, leaf, counts, units):
        yield a, np.bincount(np.repeat(np.arange(len(c)) * units, c) + drawn, minlength=len(c) * units).reshape(len(c), units)


def _added(values, counts):
    """Sums of consecutive runs of ``values``, of which run k has ``counts[k]``."""
    import numpy as np

    out = np.zeros(len(counts))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def class_draws(seed: int, group: tuple, leaf: int, counts, units):
    """As :func:`uniform_weights`, for a leaf of classes with ``units`` units each: draws x classes."""
    import numpy as np

    rng = np.random.default_rng([seed, zlib.crc32(repr(group).encode()), 1 << 23, leaf])
    step = max(1, CELLS // len(units))
    for a in range(0, len(counts), step):
        yield a, rng.multinomial(counts[a : a + step], units / units.sum())


def _weighed(weights, values):
    """Sums of the values by weights, draw by draw. A value that is no number tells only where it is drawn."""
    import numpy as np

    return weights @ values if np.isfinite(values).all() else np.where(weights > 0, weights * values, 0.0).sum(axis=1)


def leaved(units: DataFrame, by: tuple[str, ...], ids: str | None = None, counted: str | None = None) -> tuple[DataFrame, dict]:
    """``units`` (by, h, ...) with their leaf, and for each group the bits of its tree and the units before each leaf.

    A row is a unit; with ``ids`` the rows of one such value are one, with ``counted`` a row is so many.
    """
    import numpy as np

    number = F.count_distinct(ids) if ids else F.count("*")
    sizes = units.groupBy(*by).agg(number.alias("units"))
    number = F.sum(counted) if counted else number
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("units") / LEAF)), F.lit(0)), F.lit(MOST_BITS)).cast("int")
    known = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], bits.alias("bits"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    placed = units.join(sent_if_small(known), on).drop(*[f"_{c}" for c in by])
    # a shift by 64 would be one by 0
    placed = placed.withColumn("leaf", F.when(F.col("bits") == 0, F.lit(0)).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)")).cast("int"))
    shape: dict = {}
    for *group, bits, leaf, n in placed.groupBy(*by, "bits", "leaf").agg(number.alias("n")).collect():
        shape.setdefault(_named(group), (bits, np.zeros((1 << bits) + 1, np.int64)))[1][leaf + 1] = n
    for _, upto in shape.values():
        np.cumsum(upto, out=upto)
    return placed.drop("bits"), shape


def _leaves(batches, by):
    """(group, leaf, rows) from sorted Arrow batches; a leaf may span several."""
    import pandas as pd

    now, held = None, []
    for batch in batches:
        for key, part in batch.to_pandas().groupby([*by, "leaf"], dropna=False, sort=False):
            key = _named(key)
            if held and key != now:
                yield now[:-1], now[-1], pd.concat(held)
                held = []
            now = key
            held.append(part)
    if held:
        yield now[:-1], now[-1], pd.concat(held)


def bootstrap_exact(pairs: DataFrame, key: str, n_resamples: int = 10_000, ci_level: float = 0.95, cluster: bool = False, seed: int = 42, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Percentile interval of the difference of means for groups of any size, by exact multinomial draws.

    A row is drawn by itself or, with ``cluster``, with all rows of its ``key`` (null and empty are one). Result as that of ``resampling.bootstrap``.
    """
    d, unit = (F.col("score_a") - F.col("score_b")).cast("double"), F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = pairs.select(*[c.alias(n) for n, c in _text(by).items()], unit.alias("unit"), d.alias("d"))
    if cluster:
        units = rows.groupBy(*by, "unit").agg(F.sum("d").alias("d"), F.count("*").cast("double").alias("m")).withColumn("c", F.lit(1).cast("long"))
    else:
        units = rows.withColumns({"m": F.lit(1.0), "c": F.lit(1).cast("long")})
    classes = _few(units.groupBy(*by, "d", "m").agg(F.count("*").alias("c")))
    if classes is None:
        units = units.withColumn("h", _seed_key(seed, "unit", *["d"] * (not cluster)))
    else:
        units = classes.withColumns({"unit": F.lit(""), "h": _seed_key(seed, "d", "m")})
    placed, shape = leaved(units, by, counted="c")
    names = [*by, "draw", "total", "weight"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[tuple, np.ndarray] = {}
        memo: dict = {}

        def emitted():
            for group, total in sums.items():
                yield pa.RecordBatch.from_arrays([*[pa.array([g] * n_resamples, pa.string()) for g in group], pa.array(np.arange(n_resamples, dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=names)

        for group, leaf, part in _leaves(batches, by):
            if group not in sums and len(sums) >= GROUPS:
                yield from emitted()
                sums.clear()
            bits, upto = shape[group]
            total, d, m, size = sums.setdefault(group, np.zeros((n_resamples, 2))), part["d"].to_numpy(float), part["m"].to_numpy(float), part["c"].to_numpy(np.int64)
            counts = leaf_draws(seed, group, leaf, bits, upto, n_resamples, memo)
            if (size > 1).any():
                for a, w in class_draws(seed, group, leaf, counts, size):
                    total[a : a + len(w)] += np.stack([_weighed(w, d), _weighed(w, m)], axis=1)
                continue
            for a, c, drawn in uniform_draws(seed, group, leaf, counts, len(part)):
                total[a : a + len(c), 0] += _added(d[drawn], c)
                total[a : a + len(c), 1] += _added(m[drawn], c) if cluster else c
        yield from emitted()

    order = [*by, "leaf", "h", "unit", "d"]
    # a leaf is few bytes and much work, so that partitions shouldn't be put together by their bytes
    number = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select(*order, "m", "c").repartition(number, *by, "leaf").sortWithinPartitions(*order, "m")
    parts = dealt.mapInArrow(run, ", ".join(f"{c} string" for c in by) + ", draw int, total double, weight double")
    tail = (1 - ci_level) / 2
    drawn = parts.groupBy(*by, "draw").agg((F.sum("total") / F.sum("weight")).alias("stat"))
    bounds = drawn.groupBy(*by).agg(F.percentile("stat", [tail, 1 - tail]).alias("ci"), F.count("*").cast("int").alias("n_resamples"))
    point = units.groupBy(*by).agg((F.sum(F.col("c") * F.col("d")) / F.sum(F.col("c") * F.col("m"))).alias("point_estimate"), F.sum("c").alias("n_units_resampled"))
    return _same_groups(point, bounds, by).select(*by, "point_estimate", F.col("ci")[0].alias("ci_lower"), F.col("ci")[1].alias("ci_upper"), "n_resamples", F.lit(key if cluster else None).cast("string").alias("cluster_by"), "n_units_resampled")


def permutation_exact(pairs: DataFrame, key: str, n_permutations: int = 10_000, alternative: str = "two-sided", seed: int = 42, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Sign-flip test of means for groups of any size, with one sign for each key: over the counts of equal sizes, or row by row if there are many.

    Result as that of ``resampling.permutation``. A difference that is null makes its group's null distribution NaN.
    """
    if alternative not in ALTERNATIVES:
        raise ValueError(f"unsupported alternative: {alternative}")
    d = F.coalesce((F.col("score_a") - F.col("score_b")).cast("double"), F.lit(float("nan")))
    units = pairs.select(*[c.alias(n) for n, c in _text(by).items()], F.col(key).alias("unit"), d.alias("d")).groupBy(*by, "unit").agg(F.sum("d").alias("d"), F.count("*").alias("m"))
    classes = _few(units.groupBy(*by, F.abs("d").alias("size")).agg(F.count("*").alias("c"), F.sum("m").alias("m")))
    if classes is None:
        return permutation_by_key(pairs, key, n_permutations, alternative, seed, by)

    def run(at, counted):
        import numpy as np

        counted = counted.sort_values("size")
        size, c, n = counted["size"].to_numpy(float), counted["c"].to_numpy(np.int64), int(counted["m"].sum())
        rng = np.random.default_rng([seed, zlib.crc32(repr(_named(at[:-1])).encode()), 1 << 24, at[-1]])
        step = max(1, CELLS // len(c))
        stats = [(2 * rng.binomial(c, 0.5, size=(min(step, BLOCK - a), len(c))) - c) @ size / n for a in range(0, BLOCK, step)]
        return _drawn_frame(by, at, n_permutations, np.concatenate(stats))

    return null_summary(_in_blocks(classes, n_permutations, by).applyInPandas(run, _draw_schema(by)), pairs, alternative, by)


def _few(classes: DataFrame) -> DataFrame | None:
    """The classes, fetched once, if there are at most CLASSES of them."""
    rows = classes.take(CLASSES + 1)
    return classes.sparkSession.createDataFrame(rows, classes.schema) if len(rows) <= CLASSES else None


def _same_groups(left: DataFrame, right: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    other = right.withColumnsRenamed({c: f"_{c}" for c in by})
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], how).drop(*[f"_{c}" for c in by])


# ---- medians ----


#: Shares of the ranks from which a window's half is taken: powers of 1/2.
STEPS = tuple(2.0**-k for k in range(1, 17))
#: Of the sketch that places windows: its error in ranks is one part in so many.
ACCURACY = 100_000


def _step(share: Column) -> Column:
    """Index of the least of STEPS that is ``share`` or more (the first, if none is)."""
    return F.least(F.greatest(F.floor(-F.log2(share)) - 1, F.lit(0)), F.lit(len(STEPS) - 1)).cast("int")


def _kept(small: DataFrame) -> DataFrame:
    """A row for each group, computed once."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def windows(rows: DataFrame, values: tuple[str, ...], units: Column, reach: float, by: tuple[str, ...]) -> DataFrame:
    """by, units, and for each value column its low and high end: the ranks around the median that a resample's may take."""
    counted = rows.groupBy(*by).agg(units.alias("units"))
    # sketches only place the window; what is in it is counted exactly
    marks = [0.5 - s for s in STEPS] + [0.5 + s for s in STEPS]
    sketch = rows.groupBy(*by).agg(*[F.percentile_approx(v, marks, ACCURACY).alias(v) for v in values])
    at = _step(F.lit(reach) / F.sqrt("units"))
    ends = [x for v in values for x in (F.col(v)[at].alias(f"{v}_low"), F.col(v)[at + len(STEPS)].alias(f"{v}_high"))]
    return _kept(_same_groups(counted, sketch, by).select(*by, "units", *ends))


def own_medians(rows: DataFrame, ends: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """by, median: exact, from the rows below the window and the counts of values in it."""
    placed = _same_groups(rows, sent_if_small(ends), by).where(F.col(value) <= F.col(f"{value}_high"))
    spot = F.when(F.col(value) >= F.col(f"{value}_low"), F.col(value))
    counted = placed.groupBy(*by, spot.alias("v")).agg(F.count("*").alias("c"))
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    # null, the rows below, comes first; the window of a group is of some 16 sqrt(n) values at most
    upto = counted.withColumn("upto", F.sum("c").over(W.partitionBy(*by).orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    both = _same_groups(upto, sent_if_small(n), by)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return both.groupBy(*by).agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"))


def _draw_medians(parts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, side, draw, median from partial weights: null where it lies outside the window.

    ``parts``: by, side, block, kind (0 total, 1 below the window, 2 at ``value``), value, weights of the block's draws.
    """
    names = [*by, "side", "draw", "median"]

    def run(key, rows):
        import numpy as np
        import pandas as pd

        weights = np.stack([np.frombuffer(w, "<i8") for w in rows["weights"]])
        kind, value = rows["kind"].to_numpy(), rows["value"].to_numpy(float)
        total, below = weights[kind == 0].sum(axis=0), weights[kind == 1].sum(axis=0)
        at, inverse = np.unique(value[kind == 2], return_inverse=True)
        sums = np.zeros((len(at), weights.shape[1]), np.int64)
        np.add.at(sums, inverse, weights[kind == 2])
        median = _median(total, below, sums.T, at)
        first = key[-1] * BLOCK
        out = pd.DataFrame({"draw": np.arange(first, first + len(median)), "median": median})
        for name, k in zip([*by, "side"], key):
            out[name] = k
        return out[names]

    schema = ", ".join(f"{c} string" for c in by) + ", side string, draw int, median double"
    found = parts.groupBy(*by, "side", "block").applyInPandas(run, schema)
    return found.withColumn("median", F.when(~F.isnan("median"), F.col("median")))


class _Sums:
    """The partial weights that one task adds up, and their rows."""

    def __init__(self, draws: int, by: tuple[str, ...]):
        self.draws, self.by, self.held = draws, by, {}

    def add(self, group, side, kind, value, first, weights) -> None:
        import numpy as np

        total = self.held.get((group, side, kind, value))
        if total is None:
            total = self.held[group, side, kind, value] = np.zeros(self.draws, np.int64)
        total[first : first + len(weights)] += weights

    def rows(self, most: int = 0):
        """Everything, as Arrow batches, once more than ``most`` sums are held."""
        import pyarrow as pa

        if len(self.held) <= most:
            return
        names = [*self.by, "side", "block", "kind", "value", "weights"]
        out = []
        for (group, side, kind, value), total in self.held.items():
            out += [(*group, side, b, kind, value, total[b * BLOCK : (b + 1) * BLOCK].astype("<i8").tobytes()) for b in range(-(-self.draws // BLOCK))]
        self.held = {}
        kinds = [*[pa.string()] * (len(self.by) + 1), pa.int32(), pa.int32(), pa.float64(), pa.binary()]
        for a in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 10_000]), kinds)], names=names)


def _partial_schema(by) -> str:
    return ", ".join(f"{c} string" for c in by) + ", side string, block int, kind int, value double, weights binary"


def median_bootstrap(pairs: DataFrame, key: str, n_resamples: int = 10_000, ci_level: float = 0.95, cluster: bool = False, seed: int = 42, by: tuple[str, ...] = GROUP, reach: float = REACH) -> DataFrame:
    """Percentile interval of median(score_a) - median(score_b) for groups of any size, by exact multinomial draws.

    ``cluster``: all rows of a ``key`` (null and empty are one) are drawn together. Result as that of ``resampling.bootstrap``.
    """
    rows = pairs.select(*[c.alias(n) for n, c in _text(by).items()], F.coalesce(F.col(key).cast("string"), F.lit("")).alias("unit"), F.col("score_a").cast("double").alias("a"), F.col("score_b").cast("double").alias("b"))
    rows = rows.withColumn("h", _seed_key(seed, "unit"))
    number = F.count_distinct("unit") if cluster else F.count("*")
    while True:
        ends = windows(rows, ("a", "b"), number, reach, by)
        placed = _same_groups(rows, sent_if_small(ends), by)
        spot = lambda x: F.when(F.col(x) < F.col(f"{x}_low"), 1).when(F.col(x) <= F.col(f"{x}_high"), 2).otherwise(3)
        spots = [*[spot(x).alias(f"k{x}") for x in "ab"], *[F.when(spot(x) == 2, F.col(x)).alias(x) for x in "ab"]]
        # what a group, or a large cluster of it, holds outside the windows is one row for each side of them
        placed = placed.select(*by, *["unit", "h"] * cluster, *spots).groupBy(*by, *["unit", "h"] * cluster, "ka", "kb", "a", "b").agg(F.count("*").alias("c"))
        if cluster:
            side = lambda s: F.max(F.when(F.col("side") == s, F.col("median")))
            drawn = _draw_medians(_cluster_parts(placed, n_resamples, seed, by), by)
            stats = drawn.groupBy(*by, "draw").agg((side("a") - side("b")).alias("stat"))
        else:
            stats = _class_medians(placed, n_resamples, seed, by)
        tail = (1 - ci_level) / 2
        bounds = stats.groupBy(*by).agg(F.percentile("stat", [tail, 1 - tail]).alias("ci"), F.count("*").cast("int").alias("n_resamples"), F.count_if(F.col("stat").isNull()).alias("outside"))
        middle = lambda x: own_medians(rows, ends, x, by).withColumnRenamed("median", f"m{x}")
        point = _same_groups(_same_groups(middle("a"), middle("b"), by), ends.select(*by, "units"), by)
        out = _same_groups(point, bounds, by).select(*by, (F.col("ma") - F.col("mb")).alias("point_estimate"), F.col("ci")[0].alias("ci_lower"), F.col("ci")[1].alias("ci_upper"), "n_resamples", F.lit(key if cluster else None).cast("string").alias("cluster_by"), F.col("units").alias("n_units_resampled"), "outside").collect()
        if not any(r.outside for r in out):
            schema = ", ".join(f"{c} string" for c in by) + ", point_estimate double, ci_lower double, ci_upper double, n_resamples int, cluster_by string, n_units_resampled long"
            return pairs.sparkSession.createDataFrame([r[:-1] for r in out], schema)
        reach *= 4


def _ranked(below, upto, at, rank):
    """The value at each draw's rank, NaN outside the window. ``upto``: draws x values, weights up to each value in ``at``, those below included."""
    import numpy as np

    place = (upto <= rank[:, None]).sum(axis=1)
    inside = (rank >= below) & (place < len(at))
    return np.where(inside, at[np.minimum(place, len(at) - 1)] if len(at) else np.nan, np.nan)


def _median(total, below, weights, at):
    import numpy as np

    upto = below[:, None] + np.cumsum(weights, axis=1)
    return (_ranked(below, upto, at, (total - 1) // 2) + _ranked(below, upto, at, total // 2)) / 2


def _in_blocks(counted: DataFrame, draws: int, by: tuple[str, ...]):
    """Counted classes once for each block of draws, grouped by both."""
    return counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // BLOCK) - 1)))).groupBy(*by, "block")


def _drawn_frame(by, key, draws, stats):
    import numpy as np
    import pandas as pd

    first = key[-1] * BLOCK
    out = pd.DataFrame({"draw": np.arange(first, first + len(stats)), "stat": stats})[: max(0, draws - first)]
    for name, k in zip(by, key):
        out[name] = k
    return out[[*by, "draw", "stat"]]


def _draw_schema(by) -> str:
    return ", ".join(f"{c} string" for c in by) + ", draw int, stat double"


def _class_medians(counted: DataFrame, draws: int, seed: int, by: tuple[str, ...]) -> DataFrame:
    """by, draw, stat: the difference of medians of each resample; ``counted``: the rows of each class (ka, kb, a, b, c)."""

    def run(key, rows):
        import numpy as np

        rows = rows.sort_values(["ka", "kb", "a", "b"])
        c = rows["c"].to_numpy(np.int64)
        n, stats = int(c.sum()), []
        rng = np.random.default_rng([seed, zlib.crc32(repr(_named(key[:-1])).encode()), 1 << 21, key[-1]])
        step = max(1, CELLS // len(c))
        for a in range(0, BLOCK, step):
            w = rng.multinomial(n, c / n, size=min(step, BLOCK - a))
            each = []
            for x in "ab":
                kind, value = rows[f"k{x}"].to_numpy(), rows[x].to_numpy(float)
                at, place = np.unique(value[kind == 2], return_inverse=True)
                sums = np.zeros((len(w), len(at)), np.int64)
                np.add.at(sums.T, place, w[:, kind == 2].T)
                each.append(_median(np.full(len(w), n), w[:, kind == 1].sum(axis=1), sums, at))
            stats.append(each[0] - each[1])
        return _drawn_frame(by, key, draws, np.concatenate(stats))

    found = _in_blocks(counted, draws, by).applyInPandas(run, _draw_schema(by))
    return found.withColumn("stat", F.when(~F.isnan("stat"), F.col("stat")))


def _cluster_parts(placed: DataFrame, draws: int, seed: int, by: tuple[str, ...]) -> DataFrame:
    units, shape = leaved(placed, by, "unit")

    def run(batches):
        import numpy as np
        import pandas as pd

        sums, memo = _Sums(draws, by), {}
        for group, leaf, part in _leaves(batches, by):
            counts = leaf_draws(seed, group, leaf, *shape[group], draws, memo)
            own, times = pd.factorize(part["unit"])[0], part["c"].to_numpy(float)
            names, each = [], []
            for x in "ab":
                kind, value = part[f"k{x}"].to_numpy(), part[x].to_numpy(float)
                values = np.unique(value[kind == 2])
                # the rows above a window, below it, and at each of its values
                code = np.where(kind == 1, 1, np.where(kind == 2, 2 + np.searchsorted(values, value), 0))
                table = np.zeros((own.max() + 1, 2 + len(values)))
                np.add.at(table, (own, code), times)
                each.append(table)
                names.append([(1, None), *[(2, float(v)) for v in values]])
            for a, w in uniform_weights(seed, group, leaf, counts, own.max() + 1):
                for x, table, named in zip("ab", each, names):
                    found = np.rint(w.astype(float) @ table).astype(np.int64)
                    sums.add(group, x, 0, None, a, found.sum(axis=1))
                    for k, (kind, value) in enumerate(named, 1):
                        sums.add(group, x, kind, value, a, found[:, k])
            yield from sums.rows(4 * VALUES)
        yield from sums.rows()

    order = [*by, "leaf", "h", "unit", "ka", "kb", "a", "b"]
    dealt = units.select(*order, "c").repartition(*by, "leaf").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, _partial_schema(by))


def median_permutation(pairs: DataFrame, n_permutations: int = 10_000, alternative: str = "two-sided", seed: int = 42, by: tuple[str, ...] = GROUP, reach: float = 2 * REACH) -> DataFrame:
    """Sign-flip test of the median of score_a - score_b for groups of any size, with a sign for each row."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"unsupported alternative: {alternative}")
    d = (F.col("score_a") - F.col("score_b")).cast("double")
    rows = pairs.select(*[c.alias(n) for n, c in _text(by).items()], d.alias("d"), F.abs(d).alias("size"))
    observed = _kept(own_medians(rows, windows(rows, ("d",), F.count("*"), reach, by), "d", by).withColumnRenamed("median", "observed_statistic"))

    def run(key, counted):
        import numpy as np

        counted = counted.sort_values("v")
        n, outside = int(counted["c"].sum()), int(counted["c"][counted["v"].isna()].sum())
        inside = counted[counted["v"].notna()]
        size, c = inside["v"].to_numpy(float), inside["c"].to_numpy(np.int64)
        rng = np.random.default_rng([seed, zlib.crc32(repr(_named(key[:-1])).encode()), 1 << 22, key[-1]])
        stats, step = [], max(1, CELLS // max(1, len(c)))
        at = np.concatenate([-size[size > 0][::-1], size])
        for a in range(0, BLOCK, step):
            draws = min(step, BLOCK - a)
            below = rng.binomial(outside, 0.5, size=draws)
            flipped = rng.binomial(c, 0.5, size=(draws, len(c)))
            flipped[:, size == 0] = 0
            weights = np.concatenate([flipped[:, size > 0][:, ::-1], c - flipped], axis=1)
            stats.append(_median(np.full(draws, n), below, weights, at))
        return _drawn_frame(by, key, n_permutations, np.concatenate(stats))

    while True:
        # flipped values stand around zero: the window is the rows of the smallest sizes
        counted = rows.groupBy(*by).agg(F.count("*").alias("units"), F.percentile_approx("size", [2 * s for s in STEPS], ACCURACY).alias("sizes"))
        ends = _kept(counted.select(*by, F.col("sizes")[_step(F.lit(reach) / F.sqrt("units") / 2)].alias("most")))
        placed = _same_groups(rows, sent_if_small(ends), by).groupBy(*by, F.when(F.col("size") <= F.col("most"), F.col("size")).alias("v")).agg(F.count("*").alias("c"))
        null = _in_blocks(placed, n_permutations, by).applyInPandas(run, _draw_schema(by)).withColumn("stat", F.when(~F.isnan("stat"), F.col("stat")))
        seen, slack = F.col("observed_statistic"), 1e-9 * F.greatest(F.lit(1.0), F.abs("observed_statistic"))
        stat = F.col("stat")
        extreme = {"two-sided": F.abs(stat) >= F.abs(seen) - slack, "greater": stat >= seen - slack, "less": stat <= seen + slack}[alternative]
        both = _same_groups(null, sent_if_small(observed), by)
        out = both.groupBy(*by, "observed_statistic").agg(F.avg(extreme.cast("double")).alias("p_value"), F.count("*").cast("int").alias("n_permutations"), F.stddev_pop(stat).alias("null_distribution_std"), F.count_if(stat.isNull()).alias("outside")).collect()
        if not any(r.outside for r in out):
            schema = ", ".join(f"{c} string" for c in by) + ", observed_statistic double, p_value double, n_permutations int, null_distribution_std double"
            return pairs.sparkSession.createDataFrame([r[:-1] for r in out], schema)
        reach *= 4
