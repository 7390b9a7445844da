"""Pairwise judging: prompts in both orders, position bias, and debiased verdicts by majority."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..fixed import DIMENSIONS, POSITION_BIAS_THRESHOLD
from ..functions import parsing, prompts
from ..functions.text import percent, render

BUILDERS = {"pairwise": prompts.pairwise, "pairwise_cot": prompts.reasoned}


def identity(winner: Column, order: Column) -> Column:
    """Which summary a slot's verdict means, by the order shown."""
    first, second = F.when(order == "original", "summary_1").otherwise("summary_2"), F.when(order == "original", "summary_2").otherwise("summary_1")
    return F.when(winner == "A", first).when(winner == "B", second).when(winner == "tie", "tie")


def order_jobs(pairs: DataFrame, judge_type: str = "pairwise", dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Two prompts for each pair and dimension. ``pairs``: article, summary_1, summary_2 and keys; prompts come last, so only keys are shuffled before."""
    each = pairs.withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions)))).withColumn("ord", F.explode(F.array(F.lit("original"), F.lit("swapped"))))
    first = F.when(F.col("ord") == "original", F.col("summary_1")).otherwise(F.col("summary_2"))
    second = F.when(F.col("ord") == "original", F.col("summary_2")).otherwise(F.col("summary_1"))
    return each.withColumn("prompt", BUILDERS[judge_type](F.col("article"), first, second, F.col("dimension"))).drop("article", "summary_1", "summary_2")


def winners(calls: DataFrame, judge_type: str = "pairwise") -> DataFrame:
    """Add winner (summary_1, summary_2, tie, null) to calls with ord and raw_response."""
    return calls.withColumn("winner", identity(parsing.PARSERS[judge_type](F.col("raw_response"))["winner"], F.col("ord")))


def both_orders(judged: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each pair and dimension with both winners, consistent and note: one shuffle by key."""
    pick = lambda o: F.max(F.when(F.col("ord") == o, F.col("winner")))
    both = judged.groupBy(*keys, "dimension").agg(pick("original").alias("winner_original_order"), pick("swapped").alias("winner_swapped_order"))
    a, b = F.col("winner_original_order"), F.col("winner_swapped_order")
    note = (
        F.when(a.isNull() | b.isNull(), fixed.UNPARSED_NOTE)
        .when(a == b, render(fixed.CONSISTENT_NOTE, first=a))
        .otherwise(render(fixed.INCONSISTENT_NOTE, first=a, second=b))
    )
    return both.withColumns({"consistent": a == b, "note": note, "flip_slot": flip_slot(a, b)})


def flip_slot(a: Column, b: Column) -> Column:
    """Which slot a flip favours: the first shown both times, the second, or neither (a tie is in it)."""
    return F.when(a == b, None).when((a == "summary_1") & (b == "summary_2"), "A").when((a == "summary_2") & (b == "summary_1"), "B").when(a.isNotNull() & b.isNotNull(), "tie")


def bias_summary(results: DataFrame, threshold: float = POSITION_BIAS_THRESHOLD) -> DataFrame:
    """Inconsistency by dimension; pairs without an assessment count in n_comparisons and n_unparsed only."""
    counted = results.where(F.col("dimension").isNotNull()).groupBy("dimension").agg(F.count("*").alias("n_comparisons"), F.count_if(~F.col("consistent")).alias("n_inconsistent"), F.count_if(F.col("consistent").isNull()).alias("n_unparsed"))
    rated = counted.withColumn("inconsistency_rate", F.col("n_inconsistent") / F.col("n_comparisons")).withColumn("escalate", F.col("inconsistency_rate") > threshold)
    values = {"rate": percent(F.col("inconsistency_rate")), "threshold": F.lit(f"{threshold:.0%}")}
    reason = F.when(F.col("escalate"), render(fixed.BIASED_REASON, **values)).otherwise(render(fixed.UNBIASED_REASON, **values))
    return rated.withColumn("reason", reason).orderBy("dimension")


def overall_bias(results: DataFrame) -> DataFrame:
    """By dimension and over all, in one pass."""
    return results.rollup("dimension").agg(F.grouping("dimension").cast("boolean").alias("is_total"), F.count("*").alias("n_comparisons"), F.avg(F.coalesce(~F.col("consistent"), F.lit(False)).cast("double")).alias("inconsistency_rate"))


def flips(results: DataFrame) -> DataFrame:
    """Flips by dimension and favoured slot, with totals."""
    slot = flip_slot(F.col("winner_original_order"), F.col("winner_swapped_order"))
    return results.where(~F.col("consistent")).withColumn("slot", slot).cube("dimension", "slot").agg(F.count("*").alias("n_flips"), F.grouping_id("dimension", "slot").cast("long").alias("level"))


def compare_studies(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("doc_id", "dimension")) -> DataFrame:
    """Inconsistency of the same pairs under two prompts, by dimension and over all, and the change in points."""
    both = a.select(*keys, F.col("consistent").alias("ca")).join(b.select(*keys, F.col("consistent").alias("cb")), list(keys))
    rate = lambda c: F.avg(F.coalesce(~F.col(c), F.lit(False)).cast("double"))
    rates = both.rollup("dimension").agg(F.grouping("dimension").cast("boolean").alias("is_total"), F.count("*").alias("n"), rate("ca").alias("rate_a"), rate("cb").alias("rate_b"))
    return rates.withColumn("change_points", 100 * (F.col("rate_b") - F.col("rate_a")))


def combine_two(a: Column, b: Column) -> tuple[Column, Column]:
    """Winner and agreement of two orders: null if one is, the common one, else a tie."""
    null = a.isNull() | b.isNull()
    return F.when(null, None).when(a == b, a).otherwise("tie"), F.coalesce(a == b, F.lit(False))


def combine_three(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Winner of more than half the votes there are, else a tie; unanimous if all three are there and equal."""
    votes = F.array_compact(F.array(a, b, c))
    count = lambda v: F.size(F.filter(votes, lambda x: x == v))
    most = F.filter(votes, lambda x: 2 * F.size(F.filter(votes, lambda y: y == x)) > F.size(votes))
    winner = F.when(F.size(votes) == 0, None).otherwise(F.coalesce(F.try_element_at(most, F.lit(1)), F.lit("tie")))
    return winner, F.coalesce((F.size(votes) == 3) & (count(F.try_element_at(votes, F.lit(1))) == 3), F.lit(False))


def tie_break_order(seed: int, *keys: Column) -> Column:
    """A coin for each pair, from a hash."""
    bit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("long") % 2
    return F.when(bit == 0, "original").otherwise("swapped")


def second_round(both: DataFrame, seed: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pairs whose orders disagree (both understood), with the order for a third call."""
    a, b = F.col("winner_original_order"), F.col("winner_swapped_order")
    return both.where(a.isNotNull() & b.isNotNull() & (a != b)).select(*keys, "dimension", tie_break_order(seed, *map(F.col, (*keys, "dimension"))).alias("ord"))


def debias(both: DataFrame, third: DataFrame | None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Final verdicts. ``third``: keys, dimension, ord and winner of the tie-break calls; null: no tie-break."""
    a, b = F.col("winner_original_order"), F.col("winner_swapped_order")
    two, agreed = combine_two(a, b)
    if third is None:
        rows = both.withColumns({"ord3": F.lit(None).cast("string"), "winner3": F.lit(None).cast("string")})
        called = F.lit(False)
    else:
        on = [*keys, "dimension"]
        rows = both.join(third.select(*on, F.col("ord").alias("ord3"), F.col("winner").alias("winner3")), on, "left")
        called = F.col("ord3").isNotNull()
    three, unanimous = combine_three(a, b, F.col("winner3"))
    shown = F.when(F.col("ord3") == "original", "orig").otherwise("swapped")
    note = (
        F.when(called, render(fixed.TIE_BREAK_NOTE, first=a, second=b, order=shown, winner=three, unanimous=F.when(unanimous, fixed.UNANIMOUS).otherwise("")))
        .when(agreed, render(fixed.AGREED_NOTE, winner=two))
        .when(two.isNull(), fixed.INCONCLUSIVE_NOTE)
        .otherwise(fixed.DISAGREED_NOTE)
    )
    return rows.select(*keys, "dimension", F.when(called, three).otherwise(two).alias("winner"), F.when(called, unanimous).otherwise(agreed).alias("agreement"), F.when(called, 3).otherwise(2).alias("n_calls"), note.alias("note"))


def tie_break_slots(debiased: DataFrame) -> DataFrame:
    """Of verdicts after a tie-break: how many name the summary that was shown first then."""
    order = F.regexp_extract("note", r"tie-break \((orig|swapped) order", 1)
    first = F.when(order == "orig", "summary_1").when(order == "swapped", "summary_2")
    return debiased.agg(F.count_if(F.col("n_calls") == 3).alias("n_tie_breaks"), F.count_if((F.col("n_calls") == 3) & (F.col("winner") == first)).alias("n_shown_first"), F.count_if((F.col("n_calls") == 3) & F.col("agreement")).alias("n_unanimous"))


def debias_rollup(debiased: DataFrame) -> DataFrame:
    """By dimension: comparisons, calls, tie-breaks, agreement and the mix of winners."""
    mix = {w: F.count_if(F.col("winner") == w).alias(f"n_{w}") for w in ("summary_1", "summary_2", "tie")}
    return debiased.groupBy("dimension").agg(F.count("*").alias("n"), F.sum("n_calls").alias("n_calls"), F.avg((F.col("n_calls") == 3).cast("double")).alias("tie_break_share"), F.avg(F.col("agreement").cast("double")).alias("agreement_share"), *mix.values(), F.count_if(F.col("winner").isNull()).alias("n_none"))
