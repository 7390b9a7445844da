"""Free-text judge answers to scores and verdicts: chains of built-in expressions, first rule that fits wins.

Each parser returns a struct (score or winner, parse_ok, parse_note). A null answer gives nulls and false.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import AMBIGUOUS_NOTE, BARE_NOTE, FALLBACK_NOTE, LEADING_NOTE, MARKER_NOTE, NO_NUMBER_NOTE, NO_WINNER_NOTE, ONLY_NOTE, OUT_OF_NOTE, OUTSIDE_NOTE, SINGLE_NOTE, TIE_NOTE, TOKEN_NOTE
from .text import bound, listed, strip

# The patterns of the rules, in their order.
BARE_SCORE = r"\A[1-5]\z"
OUT_OF_FIVE = r"(?iu)\b([1-5])\s*(?:out of|/)\s*5\b"
SCORES = r"(?U)(\b[1-5]\b)"
NUMBERS = r"(?U)(\d+)"
BARE_VERDICT = r"(?iuU)\A[\s.]*([AB]|Tie)[\s.]*\z"
TIE = r"(?iuU)\btie\b"
LEADING = r"(?iuU)\A\W*([AB])\b"
MENTIONS = {"A": r"(?iuU)\bsummary\s+a\b", "B": r"(?iuU)\bsummary\s+b\b"}
MARKER = r"(?iuU)verdict:\s*(a|b|tie)\b"


def score(raw: Column) -> Column:
    """Score 1 to 5: a bare digit, "X out of 5" or "X/5", the only digit from 1 to 5, else null and why."""

    def read(text: Column) -> Column:
        found, numbers = F.regexp_extract_all(text, F.lit(SCORES), 1), F.regexp_extract_all(text, F.lit(NUMBERS), 1)
        return F.struct(text.alias("text"), text.rlike(BARE_SCORE).alias("bare"), F.regexp_extract(text, OUT_OF_FIVE, 1).alias("out_of"), found.alias("found"), numbers.alias("numbers"))

    def told(x: Column) -> Column:
        value = F.when(x.bare, x.text).when(x.out_of != "", x.out_of).when(F.size(x.found) == 1, F.try_element_at(x.found, F.lit(1)))
        note = (
            F.when(x.bare, BARE_NOTE)
            .when(x.out_of != "", OUT_OF_NOTE)
            .when(F.size(x.found) == 1, SINGLE_NOTE)
            .when(F.size(x.found) > 1, F.concat(F.lit(AMBIGUOUS_NOTE[0]), F.size(x.found).cast("string"), F.lit(AMBIGUOUS_NOTE[1]), listed(x.found)))
            .when(F.size(x.numbers) > 0, F.concat(F.lit(OUTSIDE_NOTE[0]), listed(x.numbers), F.lit(OUTSIDE_NOTE[1])))
            .when(x.text.isNotNull(), NO_NUMBER_NOTE)
        )
        return F.struct(value.cast("int").alias("score"), value.isNotNull().alias("parse_ok"), note.alias("parse_note"))

    return bound(bound(strip(raw), read), told)


def _named(token: Column) -> Column:
    return F.when(F.lower(token) == "tie", "tie").otherwise(F.upper(token))


def verdict(raw: Column) -> Column:
    """Winner A, B or tie: a bare token, a tie anywhere, a leading letter, the only summary named, else null."""

    def read(text: Column) -> Column:
        return F.struct(text.alias("text"), F.regexp_extract(text, BARE_VERDICT, 1).alias("bare"), F.regexp_extract(text, LEADING, 1).alias("lead"), text.rlike(TIE).alias("tie"), text.rlike(MENTIONS["A"]).alias("a"), text.rlike(MENTIONS["B"]).alias("b"))

    def told(x: Column) -> Column:
        only_a, only_b = x.a & ~x.b, x.b & ~x.a
        winner = F.when(x.bare != "", _named(x.bare)).when(x.tie, "tie").when(x.lead != "", F.upper(x.lead)).when(only_a, "A").when(only_b, "B")
        note = F.when(x.bare != "", TOKEN_NOTE).when(x.tie, TIE_NOTE).when(x.lead != "", LEADING_NOTE).when(only_a, ONLY_NOTE["A"]).when(only_b, ONLY_NOTE["B"]).when(x.text.isNotNull(), NO_WINNER_NOTE)
        return F.struct(winner.alias("winner"), winner.isNotNull().alias("parse_ok"), note.alias("parse_note"))

    return bound(bound(strip(raw), read), told)


def reasoned_verdict(raw: Column) -> Column:
    """The last verdict marker; without one, as :func:`verdict`, and the note says so."""
    last = F.try_element_at(F.regexp_extract_all(raw, F.lit(MARKER), 1), F.lit(-1))

    def told(x: Column) -> Column:
        winner = F.when(x.last.isNotNull(), _named(x.last)).otherwise(x.plain.winner)
        note = F.when(x.last.isNotNull(), MARKER_NOTE).otherwise(F.concat(F.lit(FALLBACK_NOTE), x.plain.parse_note))
        return F.struct(winner.alias("winner"), winner.isNotNull().alias("parse_ok"), note.alias("parse_note"))

    return bound(F.struct(last.alias("last"), verdict(raw).alias("plain")), told)


#: Parsers by judge type.
PARSERS = {"pointwise": score, "pairwise": verdict, "pairwise_cot": reasoned_verdict}
