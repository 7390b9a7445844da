"""Text columns: Unicode-aware trimming and number formats that round half to even."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(text: Column) -> Column:
    """White space of any script off both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, _EDGE, "")


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits).cast("double"))


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def listed(items: Column) -> Column:
    """Strings as a bracketed list in quotes."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def render(template: str, **values: Column) -> Column:
    """A template with the columns in the places of their names."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts) if p])


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
