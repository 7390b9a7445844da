import pytest
from judge_jobs.fixed import CLOSING_HEDGES, DEFINITIONS, OPENING_FILLERS
from judge_jobs.functions import padding, prompts
from judge_jobs.functions.text import fixed, percent, strip
from judge_jobs.operators import verbosity
from pyspark.sql import functions as F

TEXT = "The fire spread fast. About 12 percent burned! Crews came?  They left."


def one(spark, *columns, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(*columns).first()


def test_prompts(spark):
    p = one(spark, prompts.pointwise(F.col("a"), F.col("s"), F.col("d")), a="100% sure {x}", s="sum", d="fluency")[0]
    assert "100% sure {x}" in p and DEFINITIONS["fluency"] in p and p.startswith("You are evaluating ONLY the fluency of a summary.") and p.endswith("nothing else.")
    p = one(spark, prompts.pairwise(F.col("a"), F.lit("first"), F.lit("second"), F.col("d")), a="art", d="relevance")[0]
    assert "Summary A:\nfirst\n\nSummary B:\nsecond" in p and p.endswith("Do not explain your answer.")
    p = one(spark, prompts.reasoned(F.col("a"), F.lit("first"), F.lit("second"), F.col("d")), a="art", d="relevance")[0]
    assert p.endswith("VERDICT: A\n(or VERDICT: B, or VERDICT: Tie)")


def test_unknown_dimension_fails(spark):
    with pytest.raises(Exception, match="unknown dimension: charm"):
        one(spark, prompts.pointwise(F.lit("a"), F.lit("s"), F.lit("charm")))


def pad(spark, f, text, seed=0):
    return one(spark, f(F.col("t")), t=text)[0] if seed == 0 else one(spark, f(F.col("t"), seed=F.lit(seed)), t=text)[0]


def test_fillers(spark):
    out = pad(spark, padding.with_fillers, TEXT)
    assert out == f"{OPENING_FILLERS[0]} the fire spread fast. About 12 percent burned! {OPENING_FILLERS[1]} crews came? They left."
    assert pad(spark, padding.with_fillers, TEXT, 3).startswith(OPENING_FILLERS[3])
    assert pad(spark, padding.with_fillers, "One only") == f"{OPENING_FILLERS[0]} one only"
    assert pad(spark, padding.with_fillers, "  ") == "  "


def test_restatement(spark):
    assert pad(spark, padding.with_restatement, TEXT, 4) == f"{TEXT} To put it another way, the fire spread fast. {CLOSING_HEDGES[1]}"
    assert pad(spark, padding.with_restatement, "...") == "..."
    assert pad(spark, padding.with_restatement, "") == ""


def test_verbose_is_longer_and_adds_no_numbers(spark):
    out = pad(spark, padding.verbose, TEXT)
    assert len(out) > 1.3 * len(TEXT)
    assert [c for c in out if c.isdigit()] == list("12")


def test_formats_round_half_to_even(spark):
    r = one(spark, percent(F.col("x")), percent(F.col("y")), fixed(F.col("z"), 3), strip(F.col("s")), x=0.0625, y=0.0635, z=0.15, s="\u2003a b\x1c ")
    assert list(r) == ["6.2%", "6.4%", "0.150", "a b"]


def test_compare_scores(spark):
    df = spark.createDataFrame([("d", 4, 3, "abcd", "abcdefghij"), ("d", None, 3, "", "abc")], "dimension string, original_score int, verbose_score int, original_text string, verbose_text string")
    a, b = sorted(verbosity.compare(df).collect(), key=lambda r: r.original_score is None)
    assert (a.score_delta, a.length_ratio) == (-1, 2.5)
    assert b.score_delta is None and b.length_ratio != b.length_ratio
    whole = {r.is_total: r for r in verbosity.summary(verbosity.compare(df)).collect()}
    assert whole[True].n == 1 and whole[True].lower == 1.0
