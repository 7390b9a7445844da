"""Reshapes, keys and filters of score tables. All narrow: no shuffle unless a key lookup says so."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import DIMENSIONS, EXPECTED_MODELS, SCORE_MAX, SCORE_MIN


def to_long(raw: DataFrame) -> DataFrame:
    """One row for each summary of an article; its place is the model. Too few scores fail the job, further ones are ignored."""
    n = F.size("machine_summaries")
    short = F.least(*[F.size(d) for d in DIMENSIONS]) < n
    whole = F.when(short, F.raise_error(F.concat(F.lit("fewer scores than summaries in "), F.col("id")))).otherwise(n)
    zipped = F.arrays_zip("machine_summaries", *[F.slice(d, F.lit(1), whole).alias(d) for d in DIMENSIONS])
    return raw.select(F.col("id").alias("doc_id"), F.col("text").alias("article"), F.posexplode(zipped).alias("model_index", "s")).select(
        "doc_id", "model_index", "article", F.col("s.machine_summaries").alias("summary"), *[F.col(f"s.{d}").alias(d) for d in DIMENSIONS]
    )


def by_dimension(scored: DataFrame, ids: list[str], value: str = "human_score") -> DataFrame:
    """One row for each item and dimension."""
    return scored.unpivot(ids, list(DIMENSIONS), "dimension", value)


def item_key(doc: Column, model: Column) -> Column:
    return F.concat_ws("::", doc.cast("string"), model.cast("string"))


def split_key(item: Column) -> tuple[Column, Column]:
    """Document and model of a key, cut at the last mark."""
    pattern = r"(?s)\A(.*)::(\d+)\z"
    return F.regexp_extract(item, pattern, 1), F.regexp_extract(item, pattern, 2).cast("int")


def parsed_only(results: DataFrame) -> DataFrame:
    """Answers that were understood, with the score as a number."""
    return results.where("parse_ok").withColumn("judge_score", F.col("judge_score").cast("double"))


def excluded(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("parse_ok")).alias("n_excluded"))


def complete(results: DataFrame) -> DataFrame:
    """Rows with both scores; null and NaN are missing."""
    return results.dropna(subset=["judge_score", "human_score"])


def spread(scored: DataFrame) -> DataFrame:
    """Largest less smallest of an item's scores, NaN left out."""
    seen = [F.when(~F.isnan(d), F.col(d)) for d in DIMENSIONS]
    return scored.withColumn("spread", F.greatest(*seen) - F.least(*seen))


def violations(models: int = EXPECTED_MODELS, columns: tuple[str, ...] = ("doc_id",)) -> Column:
    """Names of the rules that a scored row breaks; empty if it is valid."""
    missing = [F.when(F.col(c).isNull(), f"{c} missing") for c in (*columns, "model_index", *DIMENSIONS)]
    range_ = [F.when(F.isnan(d) | ~F.col(d).between(SCORE_MIN, SCORE_MAX), f"{d} out of range") for d in DIMENSIONS]
    return F.array_compact(F.array(*missing, F.when(~F.col("model_index").between(0, models - 1), "model_index out of range"), *range_))


def split_valid(scored: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with ``violations``."""
    marked = scored.withColumn("violations", violations(**options))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def of_documents(rows: DataFrame, flagged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of flagged documents."""
    return rows.join(flagged.select(key), key, "left_semi")
