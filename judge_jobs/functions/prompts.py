"""Judge prompts as column expressions. Text goes in by concatenation, so its signs never act as formats."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import DEFINITIONS, DIMENSIONS, PAIRWISE_PROMPT, POINTWISE_PROMPT, REASONED_PROMPT
from .text import render


def known_dimension(dimension: Column) -> Column:
    """The dimension itself; a job over any other value fails and names the valid ones."""
    message = F.concat(F.lit("unknown dimension: "), F.coalesce(dimension, F.lit("null")), F.lit(f". Must be one of {list(DIMENSIONS)}"))
    return F.when(dimension.isin(*DIMENSIONS), dimension).otherwise(F.raise_error(message))


def definition(dimension: Column) -> Column:
    return reduce(lambda when, d: when.when(dimension == d, F.lit(DEFINITIONS[d])), DIMENSIONS[1:], F.when(dimension == DIMENSIONS[0], F.lit(DEFINITIONS[DIMENSIONS[0]])))


def pointwise(article: Column, summary: Column, dimension: Column) -> Column:
    return render(POINTWISE_PROMPT, dimension=known_dimension(dimension), definition=definition(dimension), article=article, summary=summary)


def pairwise(article: Column, summary_a: Column, summary_b: Column, dimension: Column) -> Column:
    return render(PAIRWISE_PROMPT, dimension=known_dimension(dimension), definition=definition(dimension), article=article, summary_a=summary_a, summary_b=summary_b)


def reasoned(article: Column, summary_a: Column, summary_b: Column, dimension: Column) -> Column:
    return render(REASONED_PROMPT, dimension=known_dimension(dimension), definition=definition(dimension), article=article, summary_a=summary_a, summary_b=summary_b)
