"""Readers and writers of the study tables: explicit schemas, null for empty text, append-only logs."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .commits import CommittedTable

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}


def read_raw(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Wide annotations, one row for each article with parallel arrays."""
    return spark.read.schema(schemas.RAW).format(form).load(path)


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Study files with a header; quotes doubled, line feeds in fields, empty is null."""
    return spark.read.schema(schema).options(**_CSV).csv(paths)


#: Where readers put the text of a record that doesn't fit the schema.
CORRUPT = "_corrupt_record"


def read_quarantined(spark: SparkSession, paths: str | list[str], schema: T.StructType, form: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, the texts of those that don't) of CSV files with a header, or of JSON lines."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} | (_CSV if form == "csv" else {})
    rows = spark.read.schema(wide).options(**options).format(form).load(paths)
    # a field that isn't read isn't checked, and the record column alone can't be asked for: both filters look at all
    read = F.length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in schema.names])) >= 0
    bad = rows.where(F.col(CORRUPT).isNotNull() & read).select(CORRUPT, F.input_file_name().alias("file"))
    return rows.where(F.col(CORRUPT).isNull() & read).drop(CORRUPT), bad


def read_drifted(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """CSV files whose headers have the schema's columns in any order, or lack some (null) or have more (left out)."""
    alike: dict[tuple, list[str]] = {}
    for path in paths:
        alike.setdefault(tuple(spark.read.options(header=True).csv(path).columns), []).append(path)
    out = None
    for header, same in sorted(alike.items()):
        found = spark.read.schema(T.StructType([T.StructField(c, schema[c].dataType if c in schema.names else T.StringType()) for c in header])).options(**_CSV).csv(same)
        part = found.select(*[F.col(f"`{c}`") if c in header else F.lit(None).cast(schema[c].dataType).alias(c) for c in schema.names])
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """All summary files that match, whatever the order of their columns; none is an error."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(f"no summary files match {pattern}")
    return read_drifted(spark, [f.getPath().toString() for f in found], schemas.SENSITIVITY)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The event log; blank lines are skipped, malformed ones fail the job, an absent log is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.TELEMETRY)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schemas.TELEMETRY, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def event_json(df: DataFrame) -> DataFrame:
    """One column ``value``: each event as JSON text with all its fields, nulls too."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def append_telemetry(events: DataFrame, path: str) -> None:
    event_json(events).write.mode("append").text(path)


def append_telemetry_once(events: DataFrame, path: str, run_id: str) -> bool:
    """Append a run's events as JSON lines to a committed log; False if the log holds that run already."""
    return CommittedTable(events.sparkSession, path, "value string", "text").append(run_id, event_json(events))


def read_committed_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The events of all committed runs; malformed ones fail the job, an absent log is empty."""
    lines = CommittedTable(spark, path, "value string", "text").read()
    return lines.select(F.from_json("value", schemas.TELEMETRY, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def write_csv(df: DataFrame, path: str) -> None:
    """Replace a small result table by one with a header; white space around values stays."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_results(df: DataFrame, path: str, by: tuple[str, ...] = ("model_pair", "metric")) -> None:
    """Replace a result table, in folders by pair and metric so that later reads skip the others."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_judge_results(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(schemas.JUDGE_RESULTS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.JUDGE_RESULTS)


def append_judge_results(results: DataFrame, path: str) -> None:
    results.select(schemas.JUDGE_RESULTS.fieldNames()).write.mode("append").parquet(path)


def append_judge_results_once(results: DataFrame, path: str, run_id: str) -> bool:
    """Append a run's results to a committed table; False if it holds that run already."""
    return judge_results_table(results.sparkSession, path).append(run_id, results.select(schemas.JUDGE_RESULTS.fieldNames()))


def judge_results_table(spark: SparkSession, path: str) -> CommittedTable:
    return CommittedTable(spark, path, schemas.JUDGE_RESULTS)
