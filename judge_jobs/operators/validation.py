"""Dataset checks: one pass for the whole-table figures and one grouped pass for models by document."""

import contextlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import DIMENSIONS, EXPECTED_DOCS, EXPECTED_MODELS, SCORE_MAX, SCORE_MIN
from ..functions.text import listed, strip
from .ordered import exact_quantiles

REQUIRED = ("doc_id", "model_index", "article", "summary", *DIMENSIONS)
#: Documents with a wrong number of models that the report's text names unless told otherwise; ``models_per_doc`` and ``write_checked`` have all.
NAMED = 20
#: Spark's setting for the files that a task may write at once.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def models_per_doc(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.countDistinct("model_index").alias("n_models"))


def report(scored: DataFrame, docs: int = EXPECTED_DOCS, models: int = EXPECTED_MODELS, required: tuple[str, ...] = REQUIRED, named: int | None = NAMED) -> DataFrame:
    """One row: n_rows, n_unique_docs, n_bad_docs, passed, errors. Missing columns end the checks at once.

    ``named``: how many bad documents the text names, in order (None: all of them).
    """
    missing = [c for c in required if c not in scored.columns]
    if missing:
        return scored.sparkSession.createDataFrame([(0, 0, 0, False, [f"missing columns: {missing}"])], "n_rows long, n_unique_docs long, n_bad_docs long, passed boolean, errors array<string>")
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]
    outside = [F.count_if((F.col(d) < SCORE_MIN) | (F.col(d) > SCORE_MAX)).alias(f"out_{d}") for d in DIMENSIONS]
    blank = F.count_if(strip(F.col("summary")) == "") if "summary" in required else F.lit(0).cast("long")
    whole = scored.agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_unique_docs"), *nulls, *outside, blank.alias("blank"))
    bad = models_per_doc(scored).where(F.col("n_models") != models).withColumn("named", F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.col("n_models").cast("string")))
    few = (bad if named is None else bad.orderBy("doc_id").limit(named)).agg(F.array_sort(F.collect_list("named")).alias("names"))
    both = whole.crossJoin(bad.agg(F.count("*").alias("n_bad_docs"))).crossJoin(few)  # one row each
    n = lambda c: F.col(c).cast("string")
    null_columns = F.array_compact(F.array(*[F.when(F.col(f"null_{c}") > 0, c) for c in required]))
    errors = F.array(
        F.when(F.size(null_columns) > 0, F.concat(F.lit("null values found in columns: "), listed(null_columns))),
        F.when(F.col("n_unique_docs") != docs, F.concat(F.lit(f"expected {docs} unique docs, found "), n("n_unique_docs"))),
        F.when(F.col("n_bad_docs") > 0, F.concat(F.lit(f"docs with != {models} models: {{"), F.array_join("names", ", "), F.lit("}"))),
        *[F.when(F.col(f"out_{d}") > 0, F.concat(n(f"out_{d}"), F.lit(f" rows with {d} outside [{float(SCORE_MIN)},{float(SCORE_MAX)}]"))) for d in DIMENSIONS],
        F.when(F.col("blank") > 0, F.concat(n("blank"), F.lit(" rows with empty summary text"))),
    )
    return both.select("n_rows", "n_unique_docs", "n_bad_docs", F.array_compact(errors).alias("errors")).select("n_rows", "n_unique_docs", "n_bad_docs", (F.size("errors") == 0).alias("passed"), "errors")


def checked(scored: DataFrame, models: int = EXPECTED_MODELS, required: tuple[str, ...] = REQUIRED, doc: str = "doc_id", model: str = "model_index") -> DataFrame:
    """Each row with what is wrong with it: ``faults``, an array of names, empty for a good row.

    ``null_<column>`` and ``out_<dimension>`` for its own values, ``blank`` for its summary, ``models`` where its
    document hasn't the expected number of models (null documents aside), ``first_of_doc`` marks one row of each document.
    Rows meet by document; those without one are spread, so that they are no hot key. A column that is required
    but missing is an error (ValueError).
    """
    missing = [c for c in required if c not in scored.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    spread = F.when(F.col(doc).isNull(), F.monotonically_increasing_id())
    # one order for both windows, so that rows are sorted once
    own = W.partitionBy(F.col(doc), "_spread").orderBy(model)
    named = [F.when(F.col(c).isNull(), f"null_{c}") for c in required]
    named += [F.when((F.col(d) < SCORE_MIN) | (F.col(d) > SCORE_MAX), f"out_{d}") for d in DIMENSIONS if d in required]
    if "summary" in required:
        named.append(F.when(strip(F.col("summary")) == "", "blank"))
    n_models = F.size(F.collect_set(model).over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    named.append(F.when(F.col(doc).isNotNull() & (n_models != models), "models"))
    first = F.col(doc).isNotNull() & (F.row_number().over(own) == 1)
    return scored.withColumn("_spread", spread).withColumns({"faults": F.array_compact(F.array(*named)), "first_of_doc": first}).drop("_spread")


@contextlib.contextmanager
def _open_files(spark: SparkSession, number: int):
    """A task that writes inside keeps so many files open at once, and sorts rows by their folder only if there are more folders."""
    before = spark.conf.get(OPEN_FILES, None)
    spark.conf.set(OPEN_FILES, str(number))
    try:
        yield
    finally:
        spark.conf.set(OPEN_FILES, before) if before is not None else spark.conf.unset(OPEN_FILES)


def write_checked(scored: DataFrame, path: str, docs: int = EXPECTED_DOCS, models: int = EXPECTED_MODELS, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Check a table and write it in one pass: ``path``/good=true, and the other rows with their faults in ``path``/good=false.

    Returns the report (n_rows, n_unique_docs, n_bad_docs, n_bad_rows, passed, faults: name to rows), which is counted by the write
    itself. Documents with a wrong number of models are all in the table, with the fault ``models``.
    """
    names = [f"null_{c}" for c in required] + [f"out_{d}" for d in DIMENSIONS if d in required] + ["blank"] * ("summary" in required) + ["models"]
    has = lambda name: F.array_contains("faults", name)
    seen = Observation()
    rows = checked(scored, models, required)
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count_if("first_of_doc").alias("n_unique_docs"), F.count_if(F.col("first_of_doc") & has("models")).alias("n_bad_docs"), F.count_if(F.size("faults") > 0).alias("n_bad_rows")]
    watched = rows.observe(seen, *counts, *[F.count_if(has(n)).alias(n) for n in names])
    with _open_files(scored.sparkSession, 2):
        watched.drop("first_of_doc").withColumn("good", F.size("faults") == 0).write.mode("overwrite").partitionBy("good").parquet(path)
    found = seen.get
    faults = {n: found[n] for n in names if found[n]}
    row = (found["n_rows"], found["n_unique_docs"], found["n_bad_docs"], found["n_bad_rows"], not faults and found["n_unique_docs"] == docs, faults)
    return scored.sparkSession.createDataFrame([row], "n_rows long, n_unique_docs long, n_bad_docs long, n_bad_rows long, passed boolean, faults map<string,long>")


def require(scored: DataFrame, **options) -> DataFrame:
    """The table itself if its report passes; else an error with the report's."""
    found = report(scored, **options).first()
    if not found.passed:
        raise RuntimeError(f"validation failed: {found.errors}")
    return scored


def profile(scored: DataFrame) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of each dimension; a dimension without scores is left out."""
    each = scored.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("v")) for d in DIMENSIONS])).alias("e")).select("e.dimension", "e.v")
    more = (F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = F.col("quantiles")
    return exact_quantiles(each, "v", (0.25, 0.5, 0.75), ("dimension",), more=more).select("dimension", "n", "mean", "std", "min", q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), "max")


def coverage(rows: DataFrame, doc: str = "doc_id", model: str = "model_index", dimension: str = "dimension") -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct(doc).alias("n_docs"), F.countDistinct(model).alias("n_models"), F.countDistinct(dimension).alias("n_dimensions"))
