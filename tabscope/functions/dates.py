"""Dates written in mixed ways, and calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.columns import is_datetime, ref
from tabscope.functions.text import strip

# The accepted spellings, as (shape, formats tried in order).
# ISO text goes to the cast, so it has no format of its own.
_ISO = (
    r"\A\d{4}(-\d{1,2}(-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|UTC|[+-]\d{1,2}:?\d{2}))?)?)?)?\z"
)
LONGEST = 40
_SPELLINGS = [
    (r"\A\d{8}\z", ["yyyyMMdd"]),
    (r"\A\d{4}/\d{1,2}/\d{1,2}( \d{1,2}:\d{2}(:\d{2})?)?\z", ["yyyy/M/d[ H:mm[:ss]]"]),
    (r"\A\d{1,2}/\d{1,2}/\d{4}( \d{1,2}:\d{2}(:\d{2})?)?\z", ["M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]"]),
    (r"\A\d{1,2}-\d{1,2}-\d{4}\z", ["M-d-yyyy", "d-M-yyyy"]),
    (r"\A[A-Za-z]{3} \d{1,2},? \d{4}\z", ["MMM d[,] yyyy"]),
    (r"\A[A-Za-z]{4,9} \d{1,2},? \d{4}\z", ["MMMM d[,] yyyy"]),
    (r"\A\d{1,2} [A-Za-z]{3} \d{4}\z", ["d MMM yyyy"]),
    (r"\A\d{1,2} [A-Za-z]{4,9} \d{4}\z", ["d MMMM yyyy"]),
]


def parse_mixed(c: Column) -> Column:
    """Timestamp of a text in any accepted spelling, null for anything else."""
    return parse_stripped(strip(c))


def parse_stripped(text: Column) -> Column:
    """The same for text without space around it.

    The lambda binds the text to a name, so that it is computed once and not in
    each of the tests, and keeps them out of the generated code of the stage,
    which would grow too large to be compiled well.
    """
    return F.get(F.transform(F.array(text), _spelled), F.lit(0))


def _spelled(text: Column) -> Column:
    """Every spelling has four digits in a row; most text that is no date fails that one test.

    The shape is tested next, so a value is parsed at most twice.
    """
    parsed = F.when(text.rlike(_ISO), text.try_cast("timestamp"))
    for shape, formats in _SPELLINGS:
        spelled = F.initcap(text) if "A-Za-z" in shape else text
        parsed = parsed.when(
            text.rlike(shape), F.coalesce(*[F.try_to_timestamp(spelled, F.lit(f)) for f in formats])
        )
    return F.when((F.length(text) <= LONGEST) & text.rlike(r"\d{4}"), parsed)


def timestamp_of(c: Column, dtype: T.DataType) -> Column:
    return c.cast("timestamp") if is_datetime(dtype) else parse_mixed(c.cast("string"))


def day_rows(df: DataFrame, date: str, **others: Column) -> DataFrame:
    """The given columns and the calendar ``day`` of a date column or of a text column holding dates.

    A text is parsed once per row: filters on the result do not move below a
    generator, where they would repeat the parse.
    """
    c, dtype = ref(date), df.schema[date].dataType
    day = c.cast("date") if is_datetime(dtype) else F.explode(F.array(parse_mixed(c.cast("string")).cast("date")))
    return df.select(*[column.alias(name) for name, column in others.items()], day.alias("day"))


def period_start(day: Column, period: str) -> Column:
    """First day of the day, Monday-based week or month that ``day`` lies in."""
    if period == "D":
        return day
    return F.trunc(day, {"W": "week", "M": "month"}[period])


def periods_between(start: Column, end: Column, period: str) -> Column:
    """Whole periods from one period start to another."""
    if period == "M":
        months = lambda d: F.year(d) * 12 + F.month(d)
        return months(end) - months(start)
    days = F.datediff(end, start)
    return days if period == "D" else (days / 7).cast("int")


def period_label(start: Column, period: str) -> Column:
    if period == "M":
        return F.date_format(start, "yyyy-MM")
    if period == "W":
        return F.concat_ws("/", start.cast("string"), F.date_add(start, 6).cast("string"))
    return start.cast("string")
