"""Rollups of the judge-call log."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import LATENCY_PERCENTILES, THROUGHPUT_BUCKETS

KEYS = ("item_id", "dimension", "judge_type")


def pending(jobs: DataFrame, done: DataFrame, keys: tuple[str, ...] = KEYS, resume: bool = True) -> DataFrame:
    """Jobs whose key has no finished call (a failed one counts as finished); all of them without resume."""
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti") if resume else jobs


def latest(events: DataFrame) -> DataFrame:
    """The last event of each job key; ties by the event's other fields."""
    order = W.partitionBy(*KEYS).orderBy(F.desc("started_at"), F.desc("latency_ms"), F.desc("retry_count"), F.desc("parse_ok"))
    return events.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def troubled(events: DataFrame) -> DataFrame:
    """Calls with a retry or an error."""
    return events.where(F.col("error").isNotNull() | (F.col("retry_count") > 0))


def kpis(events: DataFrame) -> DataFrame:
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c).cast("double"), F.count("*")), F.lit(0.0))
    span = F.greatest(F.max("started_at") - F.min("started_at"), F.lit(1e-6))
    return events.agg(
        F.count("*").alias("n"), F.count_if("parse_ok").alias("n_ok"), F.count_if(F.col("retry_count") > 0).alias("n_retried"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.count_if("escalated").alias("n_escalated"),
        span.alias("duration_s"), (F.count("*") / span).alias("per_second"), share(F.col("parse_ok")).alias("ok_share"), share(F.col("retry_count") > 0).alias("retried_share"), share(F.col("escalated")).alias("escalated_share"),
    )


def by_dimension(events: DataFrame) -> DataFrame:
    share = lambda c: F.avg(F.col(c).cast("double"))
    return events.groupBy("dimension").agg(F.count("*").alias("n"), share("parse_ok").alias("ok_share"), share("escalated").alias("escalated_share"), F.avg("latency_ms").alias("mean_latency_ms")).orderBy("dimension")


#: Equal parts of the latency range that the first pass counts.
LATENCY_PARTS = 10_000


def latency_percentiles(events: DataFrame, percentiles: tuple[int, ...] = LATENCY_PERCENTILES, parts: int = LATENCY_PARTS) -> DataFrame:
    """Nearest-rank percentiles without interpolation (0-based index, ties to even), exact. An empty log gives 0.

    One pass counts equal parts of the range, a second looks at the values of the few parts that hold a
    wanted rank; no task orders the whole log.
    """
    seen = events.select(F.col("latency_ms").alias("v")).where(F.col("v").isNotNull())
    ends = seen.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    part = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * parts), F.lit(parts - 1)), F.lit(0)).cast("int")
    placed = seen.crossJoin(F.broadcast(ends)).select("v", "n", part.alias("part"))  # one row of ends
    counted = placed.groupBy("part").agg(F.count("*").alias("size"), F.first("n").alias("n"))
    upto = F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0))  # at most one row for each part
    ranks = F.explode(F.array(*map(F.lit, percentiles)))
    wanted = counted.withColumn("upto", upto).withColumn("pct", ranks).withColumn("at", F.rint(F.col("pct") / 100 * (F.col("n") - 1)))
    wanted = wanted.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("size"))).select("part", "pct", (F.col("at") - F.col("upto") + F.col("size")).alias("at"))
    values = placed.join(F.broadcast(wanted.select("part").distinct()), "part").groupBy("part", "v").count()
    within = values.withColumn("upto", F.sum("count").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    found = within.join(F.broadcast(wanted), "part").where(F.col("upto") > F.col("at")).groupBy("pct").agg(F.min("v").alias("latency_ms"))
    every = events.sparkSession.createDataFrame([(p,) for p in percentiles], "pct int")
    return every.join(found, "pct", "left").select("pct", F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"))


def throughput(events: DataFrame, buckets: int = THROUGHPUT_BUCKETS) -> DataFrame:
    """Calls in equal parts of the run's time; the last one is closed, and empty ones are there."""
    ends = events.agg(F.min("started_at").alias("t0"), F.max("started_at").alias("t1")).where("t0 is not null").withColumn("width", F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-6)) / buckets)
    at = F.least(F.floor((F.col("started_at") - F.col("t0")) / F.col("width")), F.lit(buckets - 1)).cast("long")
    counted = events.crossJoin(F.broadcast(ends)).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))  # one row of ends
    every = events.sparkSession.range(buckets).withColumnRenamed("id", "bucket").crossJoin(ends)
    return every.join(counted, "bucket", "left").select("bucket", (F.col("t0") + F.col("bucket") * F.col("width")).alias("starts_at"), F.coalesce("n", F.lit(0)).alias("n"))


def job_mix(events: DataFrame) -> DataFrame:
    """Calls by backend, model, judge type and dimension with all subtotals."""
    keys = ("backend", "model", "judge_type", "dimension")
    return events.cube(*keys).agg(F.count("*").alias("n"), F.grouping_id(*keys).cast("long").alias("level"))


def projection(events: DataFrame, workloads: dict[str, int]) -> DataFrame:
    """How long each workload would take at the log's rate."""
    rate = kpis(events).select("per_second")
    loads = events.sparkSession.createDataFrame(list(workloads.items()), "workload string, n_jobs long")
    seconds = F.col("n_jobs") / F.col("per_second")
    text = F.when(seconds < 60, F.format_string("%.1f s", seconds)).when(seconds < 3600, F.format_string("%.1f min", seconds / 60)).otherwise(F.format_string("%.1f h", seconds / 3600))
    return loads.crossJoin(rate).select("workload", "n_jobs", seconds.alias("seconds"), text.alias("duration"))
