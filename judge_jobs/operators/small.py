"""Joins with tables that are small as a rule, but aren't taken to be."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is sent to every task.
SENT = 10_000


def sent_if_small(small: DataFrame, most: int = SENT) -> DataFrame:
    """``small``, computed once and marked for broadcast, if it has at most ``most`` rows (no more are fetched); else as it is: the join then shuffles."""
    rows = small.take(most + 1)
    return F.broadcast(small.sparkSession.createDataFrame(rows, small.schema)) if len(rows) <= most else small
