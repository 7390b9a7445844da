"""The telemetry rollup over a growing log, and jobs counted once.

The rollup keeps sums, not shares: each micro-batch adds its sums by window and dimension to a table whose appends happen
once for each batch id, so a batch that is replayed after a crash changes nothing, every event counts, and open windows
are in it. Events later than the lateness count too, and are listed in a table of their own.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.telemetry import KEYS
from ..sources.commits import CommittedTable

SUMS = "starts_at timestamp, ends_at timestamp, dimension string, n long, n_known long, n_ok long, n_flagged long, n_escalated long, n_timed long, latency_ms double, newest timestamp"
LATE = T.StructType([*schemas.TELEMETRY.fields, T.StructField("ts", T.TimestampType())])
#: The settings under which keys of any number are kept by a stream: state on disk, not in memory.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def read(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Events of a folder of JSON-lines files as a stream, with event time ``ts``."""
    stream = spark.readStream.schema(schemas.TELEMETRY).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return stream.withColumn("ts", F.col("started_at").cast("timestamp"))


def sums(events: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """What a set of events adds to the rollup. Events without a time are in no window."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    known = lambda c: F.count(c)
    return (
        events.groupBy(window.alias("w"), "dimension")
        .agg(F.count("*").alias("n"), known("parse_ok").alias("n_known"), F.count_if("parse_ok").alias("n_ok"), known("escalated").alias("n_flagged"), F.count_if("escalated").alias("n_escalated"), known("latency_ms").alias("n_timed"), F.sum("latency_ms").alias("latency_ms"), F.max("ts").alias("newest"))
        .select(F.col("w.start").alias("starts_at"), F.col("w.end").alias("ends_at"), "dimension", "n", "n_known", "n_ok", "n_flagged", "n_escalated", "n_timed", "latency_ms", "newest")
    )


def shares(sums: DataFrame) -> DataFrame:
    """Calls, understood and escalated shares and mean latency by window and dimension."""
    total = lambda c: F.sum(c)
    share = lambda a, b: F.try_divide(total(a).cast("double"), total(b))
    return sums.groupBy("starts_at", "ends_at", "dimension").agg(total("n").alias("n"), share("n_ok", "n_known").alias("ok_share"), share("n_escalated", "n_flagged").alias("escalated_share"), share("latency_ms", "n_timed").alias("mean_latency_ms"))


class LiveRollup:
    """The rollup in one folder, fed by one stream (a checkpoint); open to readers at any time."""

    def __init__(self, spark: SparkSession, path: str, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes"):
        self.spark, self.width, self.slide, self.late = spark, width, slide, late
        self.parts = CommittedTable(spark, f"{path}/sums", SUMS)
        self.tardy = CommittedTable(spark, f"{path}/late", LATE)

    def add(self, stream: str, batch: DataFrame, batch_id: int) -> bool:
        """Count one micro-batch; False if it is counted already. Raises ValueError for a second stream."""
        run = f"{stream}:{batch_id}"
        _, _, runs = self.parts.version()
        if run in runs:
            return False
        if any(r.rpartition(":")[0] != stream for r in runs):
            raise ValueError("another stream feeds this rollup; a new checkpoint would count its events again")
        # a row for each window and dimension; what counts as late depends on the batches before, not on when this one runs
        newest = self.parts.read().agg(F.max("newest")).first()[0]
        if newest is not None:
            limit = F.lit(newest) - F.expr(f"INTERVAL {self.late}")
            self.tardy.append(run, batch.where(F.col("ts") < limit).select(*LATE.fieldNames()))
        return self.parts.append(run, sums(batch, self.width, self.slide))

    def drain(self, events: DataFrame, checkpoint: str) -> None:
        """Count what has arrived, and stop. A drain that was lost is repeated with the same checkpoint."""
        each = lambda batch, batch_id: self.add(_stream_id(self.spark, checkpoint), batch, batch_id)
        events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def read(self) -> DataFrame:
        """The rollup of all events so far, open windows included."""
        return shares(self.parts.read())

    def late_events(self) -> DataFrame:
        return self.tardy.read()


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its stream for good."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def first_of_each_job(events: DataFrame, late: str | None = None) -> DataFrame:
    """One event for each job key. Keys are kept for good, or with ``late`` for so long after their first event.

    State grows with the distinct keys: run it with ``STATE`` set in the session, so that it lies on disk.
    """
    if late is None:
        return events.dropDuplicates(list(KEYS))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(KEYS))


def drain(result: DataFrame, path: str, checkpoint: str) -> None:
    """Write what has arrived as Parquet, each input once over restarts, and stop."""
    result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
