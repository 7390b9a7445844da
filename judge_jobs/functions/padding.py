"""Padded variants of a summary: more words, no new facts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import CLOSING_HEDGES, OPENING_FILLERS, RESTATEMENT_LEAD
from .text import bound, strip

_GAP = r"(?U)(?<=[.!?])\s+"


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def _lowered(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def with_fillers(summary: Column, insertions: int = 2, seed: Column | None = None) -> Column:
    """Fillers before evenly spaced sentences, the first lowered; blank summaries stay as they are."""
    seed = F.lit(0) if seed is None else seed

    def joined(sentences: Column) -> Column:
        n = F.least(F.lit(insertions), F.size(sentences))
        step = F.greatest(F.lit(1), F.floor(F.size(sentences) / F.greatest(n, F.lit(1))).cast("int"))

        def padded(sentence: Column, at: Column) -> Column:
            nth = F.floor(at / step).cast("int")
            chosen = (at % step == 0) & (nth < n) & (sentence != "")
            return F.when(chosen, F.concat(_pick(OPENING_FILLERS, seed + nth), F.lit(" "), _lowered(sentence))).otherwise(sentence)

        return F.array_join(F.transform(sentences, padded), " ")

    return bound(strip(summary), lambda text: F.when(text == "", summary).otherwise(bound(F.split(text, _GAP), joined)))


def with_restatement(summary: Column, seed: Column | None = None) -> Column:
    """The first sentence said again, and a closing hedge; blank summaries stay as they are."""
    seed = F.lit(0) if seed is None else seed

    def restated(text: Column) -> Column:
        first = F.regexp_replace(F.element_at(F.split(text, _GAP, 2), 1), r"[.!?]+\z", "")
        return bound(first, lambda x: F.when((text == "") | (x == ""), summary).otherwise(F.concat(text, F.lit(f" {RESTATEMENT_LEAD} "), _lowered(x), F.lit(". "), _pick(CLOSING_HEDGES, seed))))

    return bound(strip(summary), restated)


def verbose(summary: Column, seed: Column | None = None) -> Column:
    return bound(with_fillers(summary, 2, seed), lambda x: with_restatement(x, seed))
