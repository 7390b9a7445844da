"""Seeded selection by hash: the same rows whatever the partitions, and the same law as a random draw."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import kept, with_group

#: How much wider than its size a sample is cut at first, in roots of the size: too narrow in fewer than one of 10^8 samples.
SLACK = 6.0


def rank_key(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def rows(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows without replacement, or all. Keys must tell rows apart. A top-k, not a full sort."""
    return df.orderBy(rank_key(seed, *map(F.col, keys)), *keys).limit(n)


def documents(df: DataFrame, n: int, seed: int, doc: str = "doc_id") -> DataFrame:
    return rows(df.select(doc).distinct(), n, seed, doc)


def two_models(scored: DataFrame, seed: int, doc: str = "doc_id", model: str = "model_index") -> DataFrame:
    """Two models of each document in random order, model_a_idx and model_b_idx; documents with fewer are left out."""
    order = W.partitionBy(doc).orderBy(rank_key(seed, F.col(doc), F.col(model)), model)
    ranked = scored.select(doc, model).distinct().withColumn("r", F.row_number().over(order)).where("r <= 2")
    pairs = ranked.groupBy(doc).agg(F.max(F.when(F.col("r") == 1, F.col(model))).alias("model_a_idx"), F.max(F.when(F.col("r") == 2, F.col(model))).alias("model_b_idx"))
    return pairs.where(F.col("model_b_idx").isNotNull())


def subsamples(df: DataFrame, size: int, trials: int, seed: int, key: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """``trials`` independent samples of ``size`` rows of each group, without replacement, with column trial: those with the smallest hashes.

    Only hashes under a share of their range, which follows from the group's count, are ordered: some ``size`` rows of a trial and group move,
    whatever the group's size; they are kept in memory, so ``df`` is read twice. Where that leaves a sample short (many rows of one key), the share is doubled, so samples are exact.
    Groups with fewer rows are taken whole; a null group is a group; an empty table gives no rows.
    """
    if trials < 1 or size < 1:
        return df.withColumn("trial", F.lit(0)).where("false")
    counts = kept(df.groupBy(*by).agg(F.count("*").alias("_n")))
    groups = sum(r["_n"] > 0 for r in counts.collect())
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), F.col(key).cast("string")))
    place = F.conv(F.substring("_hash", 1, 13), 16, 10).cast("double") / 2.0**52
    beside = lambda rows: with_group(rows, counts, by) if by else rows.withColumn("_n", F.lit(counts.first()["_n"]))
    each = beside(df).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("_hash", hashed)
    wide = 1.0
    while True:
        near = each.where(place * F.col("_n") < wide * (size + SLACK * size**0.5 + SLACK**2)).persist()
        met = near.groupBy(*by, "trial").agg(F.least(F.count("*"), F.lit(size)).alias("_met"))
        # a sum for each group, of its trials: what each sample must have
        full = beside(met.groupBy(*by).agg(F.sum("_met").alias("_met"))).where(F.col("_met") == trials * F.least("_n", F.lit(size)))
        if full.count() == groups:
            break
        near.unpersist()
        wide *= 2
    order = W.partitionBy(*by, "trial").orderBy("_hash", key)
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).drop("_r", "_n", "_hash")
