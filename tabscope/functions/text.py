"""Text helpers: whitespace, number-like text, digit groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"
_ANY_SPACE = rf"(?U){_SPACE}"
_STRIP = rf"(?U)\A{_SPACE}+|{_SPACE}+\z"
_NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
_INFINITE = r"(?i)\A[+-]?inf(inity)?\z"


def has_edge_space(c: Column) -> Column:
    """Looks at the first and the last character only, however long the text."""
    return F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1))).rlike(_ANY_SPACE)


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.when(has_edge_space(c), F.regexp_replace(c, _STRIP, "")).otherwise(c)


def to_number(c: Column) -> Column:
    """The number a text stands for, else null; unit suffixes and separators do not count."""
    return number_of_stripped(strip(c))


def number_of_stripped(trimmed: Column) -> Column:
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double")).when(
        trimmed.rlike(_INFINITE),
        F.when(trimmed.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
    )


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")
