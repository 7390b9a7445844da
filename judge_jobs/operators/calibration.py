"""Agreement of judge and human scores by dimension, and the policy that follows from it.

Four dimensions are four hot keys, so everything is sums that combine before the shuffle, over counts of distinct
pairs of scores. Ranks come from counts of parts of the values, not from a window over a dimension.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import INSIGNIFICANT_REASON, MAX_P_VALUE, MIN_PEARSON_R, TRUSTED_REASON, WEAK_REASON
from ..functions.significance import correlation_p
from ..functions.text import fixed, render
from .ordered import running_counts
from .reshape import complete
from .small import sent_if_small


def pearson(a: str, b: str) -> Column:
    """Correlation as an aggregate; null where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def average_ranks(rows: DataFrame, value: str, by: str = "dimension", name: str = "rank") -> DataFrame:
    """Average rank of each distinct value within its group: by, value, rank."""
    counted = running_counts(rows.groupBy(by, value).count(), value, (by,))
    return counted.select(by, value, (F.col("before") + (F.col("count") + 1) / 2).alias(name))


def spearman(rows: DataFrame, a: str = "judge_score", b: str = "human_score", by: str = "dimension") -> DataFrame:
    """Pearson correlation of average ranks, over counts of distinct value pairs."""
    return _spearman(rows.groupBy(by, a, b).count(), a, b, by)


def _spearman(pairs: DataFrame, a: str, b: str, by: str) -> DataFrame:
    def ranks(value, name):
        counted = running_counts(pairs.groupBy(by, value).agg(F.sum("count").alias("count")), value, (by,))
        return counted.select(by, value, (F.col("before") + (F.col("count") + 1) / 2).alias(name))

    ranked = pairs.join(ranks(a, "ra"), [by, a]).join(ranks(b, "rb"), [by, b])
    w, s = F.col("count"), lambda e: F.sum(w * e)
    sums = ranked.groupBy(by).agg(F.sum(w).alias("n"), s(F.col("ra")).alias("a"), s(F.col("rb")).alias("b"), s(F.col("ra") * F.col("ra")).alias("aa"), s(F.col("rb") * F.col("rb")).alias("bb"), s(F.col("ra") * F.col("rb")).alias("ab"))
    top = F.col("ab") / F.col("n") - F.col("a") / F.col("n") * F.col("b") / F.col("n")
    spread = lambda x: F.col(x * 2) / F.col("n") - (F.col(x) / F.col("n")) ** 2
    return sums.select(by, F.try_divide(top, F.sqrt(spread("a") * spread("b"))).alias("spearman_r"))


def by_dimension(results: DataFrame, p_values: bool = True) -> DataFrame:
    """Agreement of judge_score and human_score; groups of fewer than two pairs are left out."""
    rows = complete(results).where(F.col("dimension").isNotNull()).withColumns({c: F.col(c).cast("double") for c in ("judge_score", "human_score")})
    error = F.col("judge_score") - F.col("human_score")
    linear = rows.groupBy("dimension").agg(F.count("*").alias("n"), pearson("judge_score", "human_score").alias("pearson_r"), F.avg(F.abs(error)).alias("mean_absolute_error"), F.avg(error).alias("mean_signed_error"))
    out = linear.where("n >= 2").join(spearman(rows), "dimension")
    if p_values:
        p_of = lambda c: correlation_p(F.col(c), F.col("n"))
        out = out.withColumns({"pearson_p": p_of("pearson_r"), "spearman_p": F.when(F.col("n") > 2, p_of("spearman_r"))})
    return out


def histogram(rows: DataFrame, value: Column, name: str = "score") -> DataFrame:
    return rows.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).count().orderBy(name)


def rounded(score: Column) -> Column:
    """Whole scores, ties to even."""
    return F.rint(score).cast("int")


def policy(calibration: DataFrame, min_pearson_r: float = MIN_PEARSON_R, max_p_value: float = MAX_P_VALUE) -> DataFrame:
    """Which dimensions to trust, and why: significant, and strong enough."""
    r, p = F.col("pearson_r"), F.col("pearson_p")
    real = lambda x: x.isNotNull() & ~F.isnan(x)  # noqa: E731  NaN counts as larger than any number
    significant, strong = real(p) & (p < max_p_value), real(r) & (F.abs(r) >= min_pearson_r)
    text = lambda x, n: F.coalesce(F.when(real(x), fixed(x, n)), F.lit("nan"))
    reason = (
        F.when(~significant, render(INSIGNIFICANT_REASON, p=text(p, 4), limit=F.lit(str(max_p_value))))
        .when(~strong, render(WEAK_REASON, r=text(F.abs(r), 3), limit=F.lit(str(min_pearson_r))))
        .otherwise(render(TRUSTED_REASON, p=text(p, 4), r=text(r, 3)))
    )
    return calibration.select("dimension", r, p, "n", (significant & strong).alias("trusted"), reason.alias("reason"))


def annotate(rows: DataFrame, policy: DataFrame, dimension: str = "dimension") -> DataFrame:
    """Add escalate_to_human: true for dimensions that are not trusted or not known. The policy has a row for each dimension."""
    known = sent_if_small(policy.select(F.col("dimension").alias("_d"), "trusted"))
    return rows.join(known, F.col(dimension) == F.col("_d"), "left").withColumn("escalate_to_human", F.coalesce(~F.col("trusted"), F.lit(True))).drop("_d", "trusted")


def escalate_calls(calls: DataFrame, policy: DataFrame | None) -> DataFrame:
    """Add escalated: answers that were not understood always go to people; without a policy nothing does."""
    if policy is None:
        return calls.withColumn("escalated", F.lit(False))
    flagged = annotate(calls, policy)
    return flagged.withColumn("escalated", ~F.coalesce("parse_ok", F.lit(False)) | F.col("escalate_to_human")).drop("escalate_to_human")


def escalation_rate(annotated: DataFrame, flag: str = "escalate_to_human") -> DataFrame:
    """By dimension, and over all (dimension null, is_total)."""
    return annotated.rollup("dimension").agg(F.grouping("dimension").cast("boolean").alias("is_total"), F.count("*").alias("n"), F.count_if(F.col(flag)).alias("n_escalated"), F.avg(F.col(flag).cast("double")).alias("escalation_rate"))
