"""Connected components by alternating stars (Kiveris et al., "Connected components in MapReduce and beyond", 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, drop_table, table

#: Rows of two longs up to which Spark may broadcast them: it takes the size of a table after an explode or an aggregation for that of the files before, which are packed.
BROADCAST_ROWS = 20_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node reachable from each node that has an edge: (node, component).

    ``edges`` holds pairs of longs; direction, repeats and loops don't matter, and pairs with a null
    are left out. Each round halves paths or better and is stored in the shared folder, so a lost
    executor costs at most one round. Only counts and checksums reach the driver.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = table(pairs.distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        mark, before = seen, now
        kept = (lambda x: x) if seen[0] <= BROADCAST_ROWS else (lambda x: x.hint("merge"))
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(kept(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(kept(least), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = table(small, "edges")
        drop_table(before)


def merged(groups: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The components (node, component) of ``groups``, itself of :func:`components`, after further edges, which are followed between groups only."""
    held = bounded(groups, BROADCAST_ROWS)
    of = lambda c: held.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    links = edges.join(of(a), a, "left").join(of(b), b, "left").select(F.coalesce(f"_{a}", a).alias(a), F.coalesce(f"_{b}", b).alias(b))
    found = table(components(links, a, b), "found")
    tops = bounded(found, BROADCAST_ROWS).select(F.col("node").alias("component"), F.col("component").alias("_top"))
    return groups.join(tops, "component", "left").select("node", F.coalesce("_top", "component").alias("component")).union(found).distinct()
