import itertools
from collections import Counter

import pytest
from judge_jobs.operators import pairwise as pw
from pyspark.sql import functions as F

VOTES = ("summary_1", "summary_2", "tie", None)


def test_combinations_by_table(spark):
    rows = list(itertools.product(VOTES, repeat=3))
    df = spark.createDataFrame(rows, "a string, b string, c string")
    two, three = pw.combine_two(F.col("a"), F.col("b")), pw.combine_three(F.col("a"), F.col("b"), F.col("c"))
    for r in df.select("a", "b", "c", two[0].alias("w2"), two[1].alias("g2"), three[0].alias("w3"), three[1].alias("g3")).collect():
        if r.a is None or r.b is None:
            assert (r.w2, r.g2) == (None, False)
        else:
            assert (r.w2, r.g2) == ((r.a, True) if r.a == r.b else ("tie", False))
        votes = [v for v in (r.a, r.b, r.c) if v is not None]
        top = Counter(votes).most_common(1)[0] if votes else (None, 0)
        want = (None if not votes else top[0] if 2 * top[1] > len(votes) else "tie", len(votes) == 3 and top[1] == 3)
        assert (r.w3, r.g3) == want


def flags(spark, *rows):
    data = [(f"{d}{k}", d, "summary_1", "summary_1" if c else "summary_2") for d, cs in rows for k, c in enumerate(cs)]
    df = spark.createDataFrame(data, "doc_id string, dimension string, winner_original_order string, winner_swapped_order string")
    return df.withColumn("consistent", F.col("winner_original_order") == F.col("winner_swapped_order"))


def test_bias_summary(spark):
    rows = flags(spark, ("a", [True] * 10), ("b", [False] * 8 + [True] * 2), ("c", [False] + [True] * 9), ("d", [False] + [True] * 4))
    found = {r.dimension: r for r in pw.bias_summary(rows).collect()}
    assert [found[d].escalate for d in "abcd"] == [False, True, False, False]  # the threshold itself does not escalate
    assert found["b"].reason == "position-inconsistency 80.0% exceeds threshold 20%; pairwise verdicts on this dimension are not reliable without order-debiasing (e.g. majority vote across both orders)"
    assert found["a"].reason == "position-inconsistency 0.0% is within threshold 20%; pairwise verdicts are usable as-is"
    assert {(r.dimension, r.slot): r.n_flips for r in pw.flips(rows).collect()}[(None, "A")] == 10


def calls(spark):
    rows = [("p", "original", "A"), ("p", "swapped", "A"), ("q", "original", "A"), ("q", "swapped", "B."), ("r", "original", "dunno"), ("r", "swapped", "A"), ("s", "original", "Tie"), ("s", "swapped", "B")]
    return spark.createDataFrame([(d, "fluency", o, a) for d, o, a in rows], "doc_id string, dimension string, ord string, raw_response string")


def test_both_orders(spark):
    found = {r.doc_id: r for r in pw.both_orders(pw.winners(calls(spark))).collect()}
    assert (found["p"].consistent, found["p"].flip_slot) == (False, "A")
    assert found["p"].note == "POSITION BIAS DETECTED: preferred 'summary_1' when shown first, 'summary_2' when shown second"
    assert found["q"].consistent and found["q"].note == "consistent: preferred 'summary_1' regardless of position"
    assert found["r"].consistent is None and found["s"].flip_slot == "tie"


@pytest.mark.parametrize("order", ["original", "swapped"])
def test_debias(spark, order):
    both = pw.both_orders(pw.winners(calls(spark)))
    assert {r.doc_id for r in pw.second_round(both, 3).collect()} == {"p", "s"}
    third = spark.createDataFrame([("p", "fluency", order, "summary_1"), ("s", "fluency", order, None)], "doc_id string, dimension string, ord string, winner string")
    found = {r.doc_id: r for r in pw.debias(both, third).collect()}
    assert (found["p"].winner, found["p"].agreement, found["p"].n_calls) == ("summary_1", False, 3)
    shown = "orig" if order == "original" else "swapped"
    assert found["p"].note == f"orders disagreed (summary_1 vs summary_2); random tie-break ({shown} order): 'summary_1'"
    assert (found["q"].winner, found["q"].n_calls, found["q"].note) == ("summary_1", 2, "orders agreed on 'summary_1'")
    assert (found["r"].winner, found["r"].agreement) == (None, False)
    assert (found["s"].winner, found["s"].n_calls) == ("tie", 3)
    slots = pw.tie_break_slots(pw.debias(both, third)).first()
    assert (slots.n_tie_breaks, slots.n_shown_first, slots.n_unanimous) == (2, 1 if order == "original" else 0, 0)


def test_order_jobs(spark):
    pairs = spark.createDataFrame([("x", "art", "one", "two")], "doc_id string, article string, summary_1 string, summary_2 string")
    found = {(r.dimension, r.ord): r.prompt for r in pw.order_jobs(pairs).collect()}
    assert len(found) == 8
    assert "Summary A:\none" in found["fluency", "original"] and "Summary A:\ntwo" in found["fluency", "swapped"]


def test_compare_studies(spark):
    a, b = flags(spark, ("a", [False, False, True, True])), flags(spark, ("a", [False, True, True, True]))
    found = {r.is_total: r for r in pw.compare_studies(a, b).collect()}
    assert (found[True].rate_a, found[True].rate_b, found[True].change_points) == (0.5, 0.25, -25)
