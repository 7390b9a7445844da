"""Ranks and exact quantiles of columns with any number of distinct values.

A sketch cuts each group's values into parts. Counts of the parts say how many rows come before each, so order
matters only within a part, and no task holds, sorts or windows over a whole group.
The sketch decides nothing but the parts: results are exact.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .small import sent_if_small

#: Parts that a group's values are cut into for ranks, and the sketch's error in ranks (one part in so many).
PARTS = 256
ACCURACY = 10_000
#: How far around a wanted quantile its own part reaches.
AROUND = 0.001
#: Cuts that are looked at one by one.
RUN = 16


def _upto(value: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda cut: cut <= value))


def part_of(value: Column, cuts: Column, n: int) -> Column:
    """How many of the ``n`` ascending cuts are ``value`` or less: every sixteenth is looked at first, then those of one run."""
    if n <= RUN:
        return _upto(value, cuts)
    firsts = F.transform(F.sequence(F.lit(RUN), F.lit(n), F.lit(RUN)), lambda k: F.element_at(cuts, k))
    run = _upto(value, firsts) * RUN
    return run + _upto(value, F.slice(cuts, run + 1, F.lit(RUN)))


def kept(small: DataFrame) -> DataFrame:
    """A row for each group, computed once and held by the driver."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def _beside(rows: DataFrame, groups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The columns of ``groups``, a row for each group, beside each row; a null group is a group. How they meet is left to the planner."""
    other = groups.withColumnsRenamed({c: f"_{c}" for c in by})
    return rows.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*[f"_{c}" for c in by])


def with_group(rows: DataFrame, groups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """As :func:`_beside`, with ``groups`` that are computed already: sent to every task if they are few."""
    return _beside(rows, sent_if_small(groups), by)


def running_counts(counted: DataFrame, value: str, by: tuple[str, ...], count: str = "count", parts: int = PARTS) -> DataFrame:
    """``counted`` (a row for each group and distinct value, with its count) with ``before``: the rows of smaller values."""
    cut = F.percentile_approx(value, [k / parts for k in range(1, parts)], ACCURACY).alias("_cuts")
    placed = _beside(counted, counted.groupBy(*by).agg(cut), by).withColumn("_part", part_of(F.col(value), F.col("_cuts"), parts - 1)).drop("_cuts")
    sums = placed.groupBy(*by, "_part").agg(F.sum(count).alias("_n"))
    # at most one row for each part of a group
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.coalesce(F.sum(count).over(W.partitionBy(*by, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return _beside(placed.withColumn("_within", within), starts, (*by, "_part")).withColumn("before", F.col("_start") + F.col("_within")).drop("_part", "_start", "_within")


def exact_quantiles(rows: DataFrame, value: str, probabilities: tuple[float, ...], by: tuple[str, ...], more: tuple[Column, ...] = (), around: float = AROUND) -> DataFrame:
    """by, n, quantiles (an array, interpolated between neighbours as ``percentile`` does), and the aggregates ``more``.

    One pass sketches and aggregates; the parts are the close surroundings of each quantile and what lies between. A second pass counts the
    parts of all groups at once, a third looks at the values of those that hold a wanted rank. Null values don't count; groups without a value are left out.
    """
    seen = rows.where(F.col(value).isNotNull())
    marks = sorted({min(max(p + e, 0.0), 1.0) for p in probabilities for e in (-around, around)})
    groups = kept(seen.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx(value, marks, ACCURACY).alias("_cuts"), *more))
    placed = with_group(seen.select(*by, value), groups.select(*by, "n", "_cuts"), by).withColumn("_part", part_of(F.col(value), F.col("_cuts"), len(marks))).drop("_cuts")
    counted = placed.groupBy(*by, "_part").agg(F.count("*").alias("_c"), F.first("n").alias("n"))
    upto = F.sum("_c").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, 0))
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p"), F.lit(end).alias("end")) for k, p in enumerate(probabilities) for end in (0, 1)]))
    at = F.col("_r.p") * (F.col("n") - 1)
    wanted = counted.withColumn("_upto", upto).withColumn("_r", ranks).withColumn("_at", F.when(F.col("_r.end") == 0, F.floor(at)).otherwise(F.ceil(at)))
    wanted = kept(wanted.where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_c"))).select(*by, "_part", "_r", (F.col("_at") - F.col("_upto") + F.col("_c")).alias("_at"), (at - F.floor(at)).alias("_share")))
    values = with_group(placed.drop("n"), wanted.select(*by, "_part").distinct(), (*by, "_part")).groupBy(*by, "_part", value).agg(F.count("*").alias("_c"))
    below = F.sum("_c").over(W.partitionBy(*by, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    found = with_group(values.withColumn("_below", below), wanted, (*by, "_part")).where(F.col("_below") > F.col("_at"))
    ends = found.groupBy(*by, F.col("_r.k").alias("_k"), F.col("_r.end").alias("_end"), "_share").agg(F.min(value).alias("_v"))
    end = lambda e: F.max(F.when(F.col("_end") == e, F.col("_v")))
    each = ends.groupBy(*by, "_k").agg((end(0) + F.max("_share") * (end(1) - end(0))).alias("_q"))
    listed = each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_q"))), lambda x: x["_q"]).alias("quantiles"))
    return with_group(groups.drop("_cuts"), listed, by)
