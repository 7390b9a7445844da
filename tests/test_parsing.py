import pytest
from judge_jobs.functions import parsing
from pyspark.sql import functions as F


def parse(spark, parser, answers, field):
    df = spark.createDataFrame(list(enumerate(answers)), "i int, raw string").withColumn("p", parser(F.col("raw")))
    return [r[0] for r in df.orderBy("i").select(f"p.{field}").collect()]


SCORES = [
    ("2", 2, "bare integer"),
    ("  4  \n", 4, "bare integer"),
    ("\u00a03\u2003", 3, "bare integer"),
    ("I would give this a 3 out of 5 overall", 3, "extracted from 'X out of 5' / 'X/5' pattern"),
    ("Score: 4/5", 4, "extracted from 'X out of 5' / 'X/5' pattern"),
    ("4 OUT OF 5", 4, "extracted from 'X out of 5' / 'X/5' pattern"),
    ("10/5", None, None),
    ("3.", 3, "single valid number embedded in text"),
    ("-3", 3, "single valid number embedded in text"),
    ("4.5", None, "ambiguous: found 2 candidate numbers ['4', '5']"),
    ("either 2 or 4", None, "ambiguous: found 2 candidate numbers ['2', '4']"),
    ("I'd give this a 7.", None, "found number(s) ['7'] but none in valid range [1,5]"),
    ("rather good", None, "no number found in response"),
    ("", None, "no number found in response"),
    (None, None, None),
]


def test_scores(spark):
    answers = [a for a, _, _ in SCORES]
    scores, notes, ok = (parse(spark, parsing.score, answers, f) for f in ("score", "parse_note", "parse_ok"))
    for (answer, score, note), s, n, k in zip(SCORES, scores, notes, ok):
        if answer == "10/5":  # the slash leaves a lone 5
            assert (s, k) == (5, True)
            continue
        assert (s, n, k) == (score, note, score is not None), answer


VERDICTS = [
    ("A", "A"), ("b", "B"), ("B.", "B"), ("tie", "tie"), (" Tie. ", "tie"), ("A, because it is concise.", "A"), ("I think it's a tie.", "tie"),
    ("Summary A is better.", "A"), ("I prefer Summary B here.", "B"), ("Summary A and Summary B are alike", None), ("hard to say", None), ("A difficult call", "A"), ("Tied hands", None), (None, None),
]


def test_verdicts(spark):
    assert parse(spark, parsing.verdict, [a for a, _ in VERDICTS], "winner") == [w for _, w in VERDICTS]
    assert parse(spark, parsing.verdict, [a for a, _ in VERDICTS], "parse_ok") == [w is not None for _, w in VERDICTS]


REASONED = [
    ("Some thoughts.\n\nVERDICT: B", "B"), ("VERDICT: Tie", "tie"), ("VERDICT: A ... on second thought VERDICT: B", "B"), ("Summary A is long, Summary B short. verdict: a", "A"),
    ("Summary A is better", "A"), ("no idea", None), ("VERDICT: Aha", None),
]


def test_reasoned_verdicts(spark):
    answers = [a for a, _ in REASONED]
    assert parse(spark, parsing.reasoned_verdict, answers, "winner") == [w for _, w in REASONED]
    notes = parse(spark, parsing.reasoned_verdict, answers, "parse_note")
    assert notes[0] == "found 'VERDICT:' marker"
    assert notes[4] == "no VERDICT marker found; fallback parse: only Summary A mentioned"


@pytest.mark.parametrize("kind", ["pointwise", "pairwise", "pairwise_cot"])
def test_every_judge_type_has_a_parser(kind):
    assert kind in parsing.PARSERS
