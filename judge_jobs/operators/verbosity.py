"""Does the judge reward length? Scores of padded summaries against the originals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(scores: DataFrame, original_text: str = "original_text", verbose_text: str = "verbose_text") -> DataFrame:
    """Add score_delta (null if a score is) and length_ratio (two decimals; NaN for an empty original)."""
    n = F.length(original_text)
    ratio = F.when(n == 0, F.lit(float("nan"))).otherwise(F.bround(F.try_divide(F.length(verbose_text).cast("double"), n), 2))
    return scores.withColumns({"score_delta": F.col("verbose_score") - F.col("original_score"), "length_ratio": ratio})


def summary(compared: DataFrame) -> DataFrame:
    """By dimension and over all: mean delta and the shares lower, higher and equal, null deltas left out."""
    share = lambda c: F.avg(c.cast("double"))
    d = F.col("score_delta")
    return compared.where(d.isNotNull()).rollup("dimension").agg(
        F.grouping("dimension").cast("boolean").alias("is_total"), F.count("*").alias("n"), F.avg(d).alias("mean_delta"), share(d < 0).alias("lower"), share(d > 0).alias("higher"), share(d == 0).alias("same"),
        F.avg(F.when(~F.isnan("length_ratio"), F.col("length_ratio"))).alias("mean_length_ratio"),
    )
