"""Calling a judge for each job, with retries. The responder is the user's: any function of prompt and model."""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.parsing import PARSERS
from .calibration import escalate_calls
from .telemetry import KEYS

CALLED = "item_id string, dimension string, judge_type string, backend string, model string, started_at double, latency_ms double, retry_count int, error string, raw_response string"

#: What the log of a durable run has beside the event.
ANSWER = T.StructType([T.StructField("raw_response", T.StringType()), T.StructField("score", T.IntegerType()), T.StructField("winner", T.StringType()), T.StructField("parse_note", T.StringType())])


def call(jobs: DataFrame, responder: Callable[[str, str], str], model: str, backend: str = "user", max_retries: int = 2, threads: int = 8, partitions: int | None = None, wait_s: float = 0.05, max_in_flight: int | None = None) -> DataFrame:
    """A row for each job with its raw answer, or its last error once retries are used up.

    ``max_in_flight`` bounds the calls that run at once over the whole cluster, whatever its size: jobs are dealt to so
    many partitions that partitions x threads stays within it. Without it, at most partitions x
    threads run at once. Calls are not to be repeated, so write the result once and read it back before further
    use, and keep speculation off for that stage.
    """
    if max_in_flight is not None:
        if max_in_flight < 1:
            raise ValueError("max_in_flight must be 1 or more")
        threads = min(threads, max_in_flight)
        partitions = min(partitions or max_in_flight, max_in_flight // threads)
    spread = jobs.repartition(partitions) if partitions else jobs

    pauses = [wait_s * k for k in range(max_retries + 1)]

    def answer(job):
        """One output row: tries end with the first answer, or the last pause."""
        start, error, text = time.time(), None, None
        for tries, pause in enumerate(pauses):
            time.sleep(pause)
            try:
                text, error = responder(job.prompt, model), None
            except Exception as failure:
                error = str(failure)
            if error is None:
                break
        return job.item_id, job.dimension, job.judge_type, backend, model, start, 1000 * (time.time() - start), tries, error, text

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        import pandas as pd

        columns = [field.split()[0] for field in CALLED.split(", ")]
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                yield pd.DataFrame(pool.map(answer, batch.itertuples(index=False)), columns=columns)

    return spread.select(schemas.JOBS.fieldNames()).mapInPandas(run, CALLED)


def parsed(called: DataFrame) -> DataFrame:
    """Add parse_ok, parse_note, score and winner by each job's judge type."""
    out = called
    each = {t: p(F.col("raw_response")) for t, p in PARSERS.items()}
    pick = lambda field, types: F.coalesce(*[F.when(F.col("judge_type") == t, each[t][field]) for t in types])
    return out.withColumns(
        {"score": pick("score", ("pointwise",)), "winner": pick("winner", ("pairwise", "pairwise_cot")), "parse_ok": F.coalesce(pick("parse_ok", PARSERS), F.lit(False)), "parse_note": pick("parse_note", PARSERS)}
    )


def events(judged: DataFrame, *more: str) -> DataFrame:
    """The log rows of judged calls (with escalated set), and the columns ``more``."""
    return judged.withColumn("extra", F.create_map().cast("map<string,string>")).select(*schemas.TELEMETRY.fieldNames(), *more)


def judge_durably(jobs: DataFrame, responder: Callable[[str, str], str], model: str, path: str, policy: DataFrame | None = None, chunks: int = 64, resume: bool = True, **options) -> DataFrame:
    """Call, parse, escalate and log all jobs that the log under ``path`` hasn't seen, a chunk of keys at a time.

    The log is the checkpoint. It grows by rounds, one for each start that has something to ask: a round keeps its
    jobs, dealt by a hash of their key into ``chunks`` folders, and the answered calls of each chunk (events with
    raw_response, score, winner and parse_note), which count once the chunk's write is committed. A start
    deals those of ``jobs`` whose key no committed chunk of any round holds (a call that failed for good counts as
    finished), so later jobs are asked, finished ones never, and a lost run loses one chunk at most; without ``resume`` it
    deals them all again. A key that occurs twice in ``jobs`` is asked once; null parts of a key are equal. Returns the whole log.
    ``options`` go to :func:`call`. One run at a time writes under a path.
    """
    spark = jobs.sparkSession
    fresh = jobs.select(schemas.JOBS.fieldNames()).dropDuplicates(list(KEYS))
    done = durable_log(spark, path)
    if resume and done is not None:
        seen = done.select(*[F.col(k).alias(f"_{k}") for k in KEYS]).distinct()
        fresh = fresh.join(seen, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS], "left_anti")
    number = len(_names(spark, f"{path}/rounds"))
    base = f"{path}/rounds/{number:06d}"
    chunk = F.pmod(F.xxhash64(*KEYS), F.lit(chunks))
    fresh.withColumn("chunk", chunk).write.partitionBy("chunk").parquet(f"{base}/jobs")
    dealt = spark.read.schema(T.StructType([*schemas.JOBS.fields, T.StructField("chunk", T.LongType())])).parquet(f"{base}/jobs")
    for name in _names(spark, f"{base}/jobs"):  # chunks without jobs have no folder
        k = int(name.partition("=")[2])
        judged = escalate_calls(parsed(call(dealt.where(F.col("chunk") == k), responder, model, **options)), policy)
        events(judged, *ANSWER.fieldNames()).write.parquet(f"{base}/log/{name}")
    log = durable_log(spark, path)
    return spark.createDataFrame([], DURABLE) if log is None else log


#: An event of a durable run.
DURABLE = T.StructType([*schemas.TELEMETRY.fields, *ANSWER.fields])


def durable_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed chunks of all rounds under ``path``, or None. The driver lists folders, not files."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rounds/*/log/chunk=*/_SUCCESS")
    marks = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []
    folders = [m.getPath().getParent().toString() for m in marks]
    return spark.read.schema(DURABLE).parquet(*folders) if folders else None


def _names(spark: SparkSession, path: str) -> list[str]:
    """Folders in a folder, in order; none if it is absent."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(folder) if f.isDirectory()) if store.exists(folder) else []


__all__ = ["KEYS", "call", "durable_log", "events", "judge_durably", "parsed"]
