"""Effect sizes of model pairs, from per-model moments (the rows are aggregated before models are paired)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def paired(long: DataFrame, a: int, b: int, keys: tuple[str, ...] = ("doc_id", "metric")) -> DataFrame:
    """Scores of two models on the same articles (score_a, score_b); articles that one lacks are left out."""
    side = lambda m, name: long.where(F.col("model_index") == m).select(*keys, F.col("score").alias(name))
    return side(a, "score_a").join(side(b, "score_b"), list(keys))


def paired_dimensions(panel: DataFrame, a: int | Column, b: int | Column, dimensions: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """As :func:`paired` for a column of scores by dimension: key, metric, score_a, score_b. Articles meet once, and not once by metric.

    A side is a model, or what its rows must fulfil.
    """
    side = lambda m, name: panel.where(m if isinstance(m, Column) else F.col("model_index") == m).select(key, *[F.col(d).alias(f"{d}_{name}") for d in dimensions])
    each = F.array(*[F.struct(F.lit(d).alias("metric"), F.col(f"{d}_a").alias("score_a"), F.col(f"{d}_b").alias("score_b")) for d in dimensions])
    return side(a, "a").join(side(b, "b"), key).select(key, F.inline(each))


def best_rows(panel: DataFrame, dimensions: tuple[str, ...], keys: tuple[str, ...] = ("doc_id", "model_index")) -> DataFrame:
    """metric, keys, score: the row with the highest score (to six places) of each dimension; of equal ones that with the least keys, nulls last.

    A dimension without scores has no row. A task keeps one row by dimension: a maximum of structs by
    metric would sort all rows, since only plain numbers have room in a hash table.
    """
    order = lambda d: F.struct(F.round(d, 6), *[-F.col(k) for k in keys])
    best = panel.agg(*[F.max_by(F.struct(*keys, F.round(d, 6).alias("score")), F.when(F.col(d).isNotNull(), order(d))).alias(d) for d in dimensions])
    each = best.select(F.explode(F.array(*[F.struct(F.lit(d).alias("metric"), F.col(d).alias("best")) for d in dimensions])).alias("e")).select("e.*")
    return each.where("best is not null").select("metric", "best.*")


def unmatched(long: DataFrame, a: int, b: int, keys: tuple[str, ...] = ("doc_id", "metric")) -> DataFrame:
    """By metric: articles that both have, and that only one has."""
    side = lambda m, name: long.where(F.col("model_index") == m).select(*keys, F.lit(1).alias(name))
    both = side(a, "ina").join(side(b, "inb"), list(keys), "full")
    return both.groupBy("metric").agg(F.count_if(F.col("ina").isNotNull() & F.col("inb").isNotNull()).alias("n_both"), F.count_if(F.col("inb").isNull()).alias("only_a"), F.count_if(F.col("ina").isNull()).alias("only_b"))


def effect_sizes(long: DataFrame) -> DataFrame:
    """Mean difference and Cohen's d (population variances) of every pair of models, by metric. ``long``: model_index, metric, score."""
    moments = long.groupBy("metric", "model_index").agg(F.avg("score").alias("mean"), F.var_pop("score").alias("var"))
    a = moments.select("metric", F.col("model_index").alias("model_a"), F.col("mean").alias("ma"), F.col("var").alias("va"))
    b = moments.select("metric", F.col("model_index").alias("model_b"), F.col("mean").alias("mb"), F.col("var").alias("vb"))
    pairs = a.join(b, (a.metric == b.metric) & (a.model_a < b.model_b)).drop(b.metric)
    diff, pooled = F.col("ma") - F.col("mb"), F.sqrt((F.col("va") + F.col("vb")) / 2)
    return pairs.select("metric", "model_a", "model_b", diff.alias("mean_diff"), F.coalesce(F.try_divide(diff, pooled), F.lit(0.0)).alias("cohens_d"))


def ranked(effects: DataFrame) -> DataFrame:
    """Pairs by size of effect within their metric; ties in order of the models."""
    by = W.partitionBy("metric")
    order = by.orderBy(F.abs(F.round("cohens_d", 9)).desc(), "model_a", "model_b")
    return effects.withColumns({"rank": F.row_number().over(order), "n_pairs": F.count("*").over(by)})


def strongest(effects: DataFrame, n: int = 5) -> DataFrame:
    return ranked(effects).where(F.col("rank") <= n)


def around_median(effects: DataFrame) -> DataFrame:
    """Five pairs around the middle of the ranking (fewer at its ends)."""
    mid = F.floor(F.col("n_pairs") / 2)
    return ranked(effects).where((F.col("rank") - 1).between(mid - 2, mid + 2))


def span(effects: DataFrame) -> DataFrame:
    """By metric: number of pairs, and the effects of smallest and largest size."""
    size = F.struct(F.abs(F.round("cohens_d", 9)), F.col("model_a"), F.col("model_b"))
    return effects.groupBy("metric").agg(F.count("*").alias("n_pairs"), F.min_by("cohens_d", size).alias("smallest_d"), F.max_by("cohens_d", size).alias("largest_d"))
