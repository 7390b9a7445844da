"""Shared helpers: a scratch table in the folder all executors share, words, and the usual input guards."""

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"


#: Spark's setting that removes a statement's shuffle files at its end.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the session's ``spark.checkpoint.dir``.

    Only on a single machine (tests) a temporary folder stands in for it; on a cluster its lack is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freeing(spark: SparkSession):
    """Statements run inside give their shuffle files back at their end."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before) if before is not None else spark.conf.unset(FREED)


def table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts the lineage. ``codec``: its compression, by default the session's.

    The copy lives on the cluster's store, so a lost executor costs no recomputation, and the shuffle
    files of the write are given back once it is done.
    """
    path, schema = shared_dir(df.sparkSession, name), df.schema
    with freeing(df.sparkSession):
        df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete scratch tables written by :func:`table` once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def bounded(stored: DataFrame, most: int) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it has at most ``most`` of them, else joined by shuffles, whatever Spark takes its size for."""
    return F.broadcast(stored) if stored.limit(most + 1).count() <= most else stored.hint("merge")


def sized_partitions(spark: SparkSession, at_least: int = 1) -> int:
    """The session's shuffle partitions, which the cluster sizes with the input."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


_spread: list = []


def bit_sums(hashes, starts):
    """How many of the 64-bit hashes of each run set each bit: one row of 64 counts for each run.

    ``starts``: where each run begins, ascending; no run is empty. Bytes are spread to eight lanes
    each by a table, so that a run of up to 255 hashes is eight additions for each hash.
    """
    import numpy as np

    if not _spread:
        _spread.append(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel())
    starts = np.asarray(starts, dtype=np.int64)
    pieces = -(-np.diff(np.append(starts, len(hashes))) // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(starts - 255 * first, pieces) + 255 * np.arange(pieces.sum())
    lanes = _spread[0][hashes.astype("<u8", copy=False).view(np.uint8)].reshape(-1, 8)
    parts = np.add.reduceat(lanes, at, axis=0).view(np.uint8).astype(np.int64)
    return np.add.reduceat(parts, first, axis=0)
