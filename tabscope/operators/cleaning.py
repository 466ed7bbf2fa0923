"""Data-quality problems and their fixes.

Detectors look at all columns in one pass and return rows
``(kind, column, count, pct, ...)``, at most eight per kind. Fixes take a table
and return a table; chained with :func:`apply_fixes` they stay one Spark plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.columns import (
    is_numeric,
    is_text,
    long_texts,
    missing_as_null,
    nested_columns,
    position_in,
    ref,
    require,
    small_table,
    text_columns,
    text_of,
)
from tabscope.functions.dates import parse_stripped, timestamp_of
from tabscope.functions.quantiles import exact_quantiles
from tabscope.functions.safe import share_pct
from tabscope.functions.text import number_of_stripped, strip, to_number
from tabscope.operators.insights import (
    Facts,
    duplicate_rows,
    gather_facts,
    missing_share,
    outlier_counts,
    tukey_fences,
)

MAX_ISSUES = 8
LOOKS_LIKE = 0.95
SHORT_DIGITS = 6

ISSUE_SCHEMA = (
    "kind string, column string, count bigint, pct double, numeric boolean, lower double, upper double, value string"
)


def _issues(rows: DataFrame, kind: str | Column, **values: Column) -> DataFrame:
    """Bring detector rows into the common issue columns."""
    values["kind"] = F.lit(kind) if isinstance(kind, str) else kind
    fields = T.StructType.fromDDL(ISSUE_SCHEMA).fields
    return rows.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def detect_duplicates(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """One row if any row repeats an earlier one."""
    n = F.col("duplicate_rows")
    found = duplicate_rows(df).filter("duplicate_rows > 0")
    rows = F.lit(facts.rows if facts else df.count())
    return _issues(found, "duplicates", count=n, pct=share_pct(n, rows))


def detect_missing(df: DataFrame, max_items: int = MAX_ISSUES, facts: Facts | None = None) -> DataFrame:
    """Columns with missing values, most first; ``numeric`` says whether a mean could fill them."""
    fillable = [f.name for f in df.schema if is_numeric(f.dataType, with_bool=True)]
    return _issues(
        missing_share(df, max_items, facts), "missing",
        column=F.col("column"), count=F.col("count"), pct=F.col("pct"), numeric=F.col("column").isin(fillable),
    )


def detect_outliers(df: DataFrame, max_items: int = MAX_ISSUES, facts: Facts | None = None) -> DataFrame:
    """Number columns with values outside the fences; the share is of all rows."""
    c = F.col("count")
    return _issues(
        outlier_counts(df, facts).orderBy(c.desc(), "column").limit(max_items), "outliers",
        column=F.col("column"), count=c, pct=share_pct(c, F.col("n_rows")), lower=F.col("lower"), upper=F.col("upper"),
    )


def detect_whitespace(df: DataFrame, max_items: int = MAX_ISSUES, facts: Facts | None = None) -> DataFrame:
    """Text columns with values that start or end in white space; the share is of present values."""
    facts = facts or gather_facts(df)
    found = [(c, n, facts.present[c]) for c, n in facts.spaced.items() if n]
    rows = small_table(df.sparkSession, found, "column string, count bigint, present bigint")
    c = F.col("count")
    return _issues(
        rows.orderBy(c.desc(), "column").limit(max_items), "whitespace",
        column=F.col("column"), count=c, pct=share_pct(c, F.col("present")),
    )


def _type_shares(trimmed: Column) -> Column:
    """Shares of the present values that are short digit groups, dates, and numbers."""
    short = (F.length(trimmed) <= SHORT_DIGITS) & trimmed.rlike(r"\A\d+\z")
    share = lambda test: F.avg(F.when(trimmed.isNotNull(), F.coalesce(test, F.lit(False)).cast("double")))
    return F.struct(
        share(short).alias("short_digits"),
        share(parse_stripped(trimmed).isNotNull()).alias("dates"),
        share(number_of_stripped(trimmed).isNotNull()).alias("numbers"),
    )


def looks_datetime(shares: Column) -> Column:
    """Dates stored as text. Short digit groups parse as dates too easily and do not count."""
    return (shares["short_digits"] < LOOKS_LIKE) & (shares["dates"] >= LOOKS_LIKE)


def looks_numeric(shares: Column) -> Column:
    return shares["numbers"] >= LOOKS_LIKE


def type_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column the three shares and the two verdicts, from one pass."""
    texts = columns if columns is not None else text_columns(df)
    trimmed = long_texts(df, texts).withColumn("value", strip(F.col("value")))
    shares = trimmed.groupBy("column").agg(_type_shares(F.col("value")).alias("s"))
    return shares.select(
        position_in(texts, F.col("column")).alias("position"),
        "column",
        "s.*",
        looks_datetime(F.col("s")).alias("looks_datetime"),
        looks_numeric(F.col("s")).alias("looks_numeric"),
    )


def date_columns(df: DataFrame) -> list[str]:
    """Candidates for a date axis: date columns, and text columns that look like dates."""
    texts = text_columns(df)
    looking = set()
    if texts:
        looking = {r["column"] for r in type_shares(df, texts).filter("looks_datetime").collect()}
    return [
        f.name
        for f in df.schema
        if f.name in looking or isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    ]


def detect_type_issues(df: DataFrame, max_items: int = MAX_ISSUES) -> DataFrame:
    """Text columns that are really dates or numbers, in column order."""
    if not text_columns(df):
        return small_table(df.sparkSession, [], ISSUE_SCHEMA)
    found = type_shares(df).filter("looks_datetime or looks_numeric").orderBy("position").limit(max_items)
    kind = F.when(F.col("looks_datetime"), "type_datetime").otherwise("type_numeric")
    return _issues(found, kind, column=F.col("column"))


def detect_constant_columns(df: DataFrame, max_items: int = MAX_ISSUES, facts: Facts | None = None) -> DataFrame:
    """Columns without any value, and columns with only one, in column order.

    Nested columns cannot be compared and are only checked for being empty.
    """
    facts = facts or gather_facts(df)
    found = []
    for c in df.columns:
        if not facts.present[c]:
            found.append(("empty_column", c, None))
        elif c in facts.constant:
            found.append(("constant_column", c, facts.constant[c]))
    rows = small_table(df.sparkSession, found[:max_items], "kind string, column string, value string")
    return _issues(rows, F.col("kind"), column=F.col("column"), value=F.col("value"))


def detect_all_issues(df: DataFrame) -> DataFrame:
    """All detectors as one table. Most of them share one pass over the rows."""
    facts = gather_facts(df)
    parts = [
        detect_duplicates(df, facts),
        detect_missing(df, facts=facts),
        detect_outliers(df, facts=facts),
        detect_whitespace(df, facts=facts),
        detect_type_issues(df),
        detect_constant_columns(df, facts=facts),
    ]
    return reduce(DataFrame.unionByName, parts)


def count_open_issues(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count("*").alias("open_issues"))


# ── fixes ────────────────────────────────────────────────────────────────────


def remove_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row of every group of identical rows, missing values alike. Nested columns are compared by their JSON text."""
    df = missing_as_null(df)
    if not nested_columns(df):
        return df.dropDuplicates()
    keys = {f"__k{i}": text_of(df, c) for i, c in enumerate(nested_columns(df))}
    flat = [c for c in df.columns if c not in nested_columns(df)]
    return df.withColumns(keys).dropDuplicates([*flat, *keys]).drop(*keys)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each combination of the keys: the first by the order, ascending with nulls first.

    Missing keys are alike, nested ones are compared by their JSON text. Rows
    equal in the order are told apart by hashes of all their cells, so the
    choice never depends on how the rows lie. It is an aggregate: each task
    keeps one row per key before the shuffle, and a key with a third of all rows
    brings no more than that from any task.
    """
    if not keys or not order:
        raise ValueError("name at least one key and one column to order by")
    require(df, *keys, *[o for o in order if isinstance(o, str)])
    clean = missing_as_null(df)
    cells = [text_of(clean, c) if c in nested_columns(clean) else ref(c) for c in clean.columns]
    pattern = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    hashes = [F.xxhash64(pattern, *cells), F.xxhash64(F.lit("second"), *cells, pattern)]
    # A null would take its row out of the comparison altogether only if the whole struct were null.
    place = F.struct(*[ref(o) if isinstance(o, str) else o for o in order], *hashes)
    by = [cells[clean.columns.index(k)].alias(f"k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[ref(c) for c in clean.columns])
    firsts = clean.select(*by, place.alias("place"), row.alias("row")).groupBy(*[f"k{i}" for i in range(len(by))])
    return firsts.agg(F.min_by("row", "place").alias("row")).select("row.*")


def _set(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(c) if c == column else ref(c) for c in df.columns])


def fill_missing(df: DataFrame, column: str, strategy: str) -> DataFrame:
    """Fill with the median, the mean, the smallest most frequent value, or zero."""
    require(df, column)
    dtype = df.schema[column].dataType
    if strategy not in ("median", "mean", "mode", "zero"):
        raise ValueError(f"no such way to fill: {strategy}")
    df = missing_as_null(df)
    c = ref(column)
    if df.filter(c.isNull()).isEmpty():
        return df
    if strategy == "median":
        (fill,) = exact_quantiles(df.select(c), [column], [0.5])[column]
    elif strategy == "mean":
        decimal = isinstance(dtype, T.DecimalType)
        fill = df.agg(F.avg(c if decimal else c.cast("double"))).first()[0]
        if decimal and fill is not None:
            return _set(df, column, F.coalesce(c, F.lit(fill)))
    elif strategy == "mode":
        # Sorting group counts, not `mode`: that would hold every distinct value in one task.
        top = df.filter(c.isNotNull()).groupBy(c.alias("v")).count().orderBy(F.desc("count"), "v").limit(1)
        found = top.select(F.col("v").cast("string")).first()
        fill = found and found[0]
    else:
        fill = 0
    if fill is None:
        return df
    if strategy in ("median", "mean"):
        return _set(df, column, F.coalesce(c.cast("double"), F.lit(float(fill))))
    return _set(df, column, F.coalesce(c, F.lit(fill).cast(dtype)))


def drop_missing_rows(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.na.drop(subset=[column])


def cap_outliers(df: DataFrame, column: str) -> DataFrame:
    """Move values beyond the fences onto them; missing values stay missing."""
    require(df, column)
    bounds = tukey_fences(df, [column]).get(column)
    if bounds is None:
        return df
    df = missing_as_null(df)
    c = ref(column).cast("double")
    low, high = F.lit(bounds[0]), F.lit(bounds[1])
    if df.filter((c < low) | (c > high)).isEmpty():
        return df
    return _set(df, column, F.when(c < low, low).when(c > high, high).otherwise(c))


def remove_outlier_rows(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    bounds = tukey_fences(df, [column]).get(column)
    if bounds is None:
        return df
    c = ref(column).cast("double")
    # NaN is missing, and rows with a missing value stay.
    return df.filter(c.isNull() | F.isnan(c) | c.between(*bounds))


def trim_whitespace(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return _set(df, column, strip(ref(column))) if is_text(df.schema[column].dataType) else df


def convert_to_numeric(df: DataFrame, column: str) -> DataFrame:
    """Text to numbers; what is not a number becomes missing."""
    require(df, column)
    dtype = df.schema[column].dataType
    if is_numeric(dtype):
        return df
    c = ref(column)
    return _set(df, column, to_number(c) if is_text(dtype) else c.cast("double"))


def convert_to_datetime(df: DataFrame, column: str) -> DataFrame:
    """Text in mixed date spellings to timestamps; what is no date becomes missing."""
    require(df, column)
    return _set(df, column, timestamp_of(ref(column), df.schema[column].dataType))


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.drop(column)


FIXES = {
    f.__name__: f
    for f in (
        remove_duplicate_rows,
        fill_missing,
        drop_missing_rows,
        cap_outliers,
        remove_outlier_rows,
        trim_whitespace,
        convert_to_numeric,
        convert_to_datetime,
        drop_column,
    )
}


def apply_fixes(df: DataFrame, steps: list[tuple[str, dict[str, Any]]]) -> DataFrame:
    """Apply named fixes in order, e.g. ``[("trim_whitespace", {"column": "city"})]``."""
    for name, arguments in steps:
        df = df.transform(FIXES[name], **arguments)
    return df
