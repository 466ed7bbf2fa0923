"""What changed between two snapshots of a table, and which segment drove it."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.columns import as_text, equals, is_nested, is_numeric, literal, missing_as_null, ref, require, small_table
from tabscope.functions import late
from tabscope.functions.kernels import moments
from tabscope.functions.safe import pct_change, tidy
from tabscope.operators.insights import distinct_counts

SIDE = "__side"
BEFORE, AFTER = "before", "after"
TOP_SHIFTS = 5


@dataclass(frozen=True)
class Pair:
    """Two snapshots as one table: every row carries the side it belongs to.

    One table instead of two means one pass and one shuffle per question, with
    conditional aggregates, where a join of two aggregates would need two.
    """

    rows: DataFrame
    schema_before: T.StructType
    schema_after: T.StructType

    def shared(self) -> list[str]:
        return [f.name for f in self.schema_before if f.name in self.schema_after.names]

    def numeric(self) -> list[str]:
        """Shared columns that are numbers (or truth values) on both sides."""
        both = (self.schema_before, self.schema_after)
        return [c for c in self.shared() if all(is_numeric(s[c].dataType, with_bool=True) for s in both)]

    def categorical(self) -> list[str]:
        """Shared columns that are numbers on neither side; dates and nested values count."""
        both = (self.schema_before, self.schema_after)
        return [c for c in self.shared() if not any(is_numeric(s[c].dataType, with_bool=True) for s in both)]

    def number(self, name: str) -> Column:
        return _number(ref(name), self.rows.schema[name].dataType)

    def text(self, name: str) -> Column:
        return as_text(ref(name), self.rows.schema[name].dataType)


def _number(c: Column, dtype: T.DataType) -> Column:
    return c.cast("int").cast("double") if isinstance(dtype, T.BooleanType) else c.cast("double")


def on(side: str, value: Column) -> Column:
    return F.when(F.col(SIDE) == side, value)


def pair_of(before: DataFrame, after: DataFrame) -> Pair:
    """Two separate tables. Shared columns of different types meet as numbers or as text."""
    before, after = missing_as_null(before), missing_as_null(after)

    def aligned(df: DataFrame, other: DataFrame, side: str) -> DataFrame:
        columns = []
        for f in df.schema:
            c = ref(f.name)
            if f.name in other.columns and other.schema[f.name].dataType != f.dataType:
                numbers = all(is_numeric(d.schema[f.name].dataType, with_bool=True) for d in (df, other))
                c = _number(c, f.dataType) if numbers else as_text(c, f.dataType)
            columns.append(c.alias(f.name))
        return df.select(*columns, F.lit(side).alias(SIDE))

    rows = aligned(before, after, BEFORE).unionByName(aligned(after, before, AFTER), allowMissingColumns=True)
    return Pair(rows, before.schema, after.schema)


def split_by_column(df: DataFrame, column: str, value_before: Any, value_after: Any) -> Pair:
    """Rows with one exact value against rows with another; both reach the scan as one filter."""
    require(df, column)
    first, second = (equals(df, column, v) for v in (value_before, value_after))
    if value_before == value_after:
        return _split(df, first, second)
    rows = df.filter(first | second).withColumn(SIDE, F.when(first, BEFORE).otherwise(AFTER))
    return Pair(missing_as_null(rows), df.schema, df.schema)


def split_by_range(df: DataFrame, column: str, range_before: tuple, range_after: tuple) -> Pair:
    """Two inclusive ranges of one column. They may overlap: such rows are on both sides."""
    require(df, column)
    dtype = df.schema[column].dataType
    tests = [
        ref(column).between(literal(low, dtype), literal(high, dtype)) for low, high in (range_before, range_after)
    ]
    try:
        apart = range_before[1] < range_after[0] or range_after[1] < range_before[0]
    except TypeError:
        apart = False
    if apart and not isinstance(dtype, T.StringType):
        rows = df.filter(tests[0] | tests[1]).withColumn(SIDE, F.when(tests[0], BEFORE).otherwise(AFTER))
        return Pair(missing_as_null(rows), df.schema, df.schema)
    return _split(df, *tests)


def _split(df: DataFrame, in_before: Column, in_after: Column) -> Pair:
    both = F.when(in_before & in_after, F.array(F.lit(BEFORE), F.lit(AFTER)))
    sides = both.otherwise(F.array(F.when(in_before, BEFORE).otherwise(AFTER)))
    rows = df.filter(in_before | in_after).withColumn(SIDE, F.explode(sides))
    return Pair(missing_as_null(rows), df.schema, df.schema)


# ── schema and metrics ───────────────────────────────────────────────────────


def compare_schemas(pair: Pair) -> DataFrame:
    """Rows ``(kind, column, before, after, pct_change)``: columns added, removed, common, retyped, and row counts."""
    a, b = pair.schema_before, pair.schema_after
    records: list[tuple] = []
    records += [("added_column", c, None, b[c].dataType.simpleString()) for c in sorted(set(b.names) - set(a.names))]
    records += [("removed_column", c, a[c].dataType.simpleString(), None) for c in sorted(set(a.names) - set(b.names))]
    for c in sorted(pair.shared()):
        before, after = a[c].dataType.simpleString(), b[c].dataType.simpleString()
        records.append(("common_column", c, before, after))
        if before != after:
            records.append(("dtype_change", c, before, after))
    counts = pair.rows.agg(F.count(on(BEFORE, F.lit(1))).alias("a"), F.count(on(AFTER, F.lit(1))).alias("b"))
    found = counts.select(
        F.lit("row_count").alias("kind"),
        F.lit(None).cast("string").alias("column"),
        F.col("a").cast("string").alias("before"),
        F.col("b").cast("string").alias("after"),
        pct_change(F.col("a"), F.col("b")).alias("pct_change"),
    )
    names = small_table(pair.rows.sparkSession, records, "kind string, column string, before string, after string")
    return names.withColumn("pct_change", F.lit(None).cast("double")).unionByName(found)


def compare_metrics(pair: Pair, columns: list[str] | None = None) -> DataFrame:
    """Sum and mean of every shared number column on both sides, largest relative change first."""
    columns = columns if columns is not None else pair.numeric()
    names = ["column", "sum_before", "sum_after", "mean_before", "mean_after"]
    if not columns:
        empty = "column string, sum_before double, sum_after double, sum_pct_change double, "
        empty += "mean_before double, mean_after double, mean_pct_change double"
        return small_table(pair.rows.sparkSession, [], empty)
    found = moments(pair.rows, {c: pair.number(c) for c in columns}, F.when(F.col(SIDE) == BEFORE, 0).otherwise(1))

    def of(c: str, side: int) -> tuple[float, float | None]:
        """Sum and mean. A side without rows has mean 0; a side whose values are all missing has none."""
        m = found.get((side, c))
        return (m.total, m.mean) if m else (0.0, 0.0)

    records = [(c, *(of(c, side)[figure] for figure in (0, 1) for side in (0, 1))) for c in columns]
    wide = small_table(pair.rows.sparkSession, records, "column string, " + ", ".join(f"{n} double" for n in names[1:]))
    zero = F.lit(0.0)
    sum_pct = pct_change(F.col("sum_before"), F.col("sum_after"))
    mean_pct = pct_change(F.col("mean_before"), F.col("mean_after"))
    return (
        wide.withColumn("sum_pct_change", sum_pct)
        .withColumn("mean_pct_change", mean_pct)
        .select(
            "column",
            *[tidy(c, 4).alias(c) for c in names[1:3]],
            "sum_pct_change",
            *[tidy(c, 4).alias(c) for c in names[3:]],
            "mean_pct_change",
        )
        .orderBy(F.coalesce(F.abs("sum_pct_change"), zero).desc(), "column")
    )


# ── categories ───────────────────────────────────────────────────────────────


def _category_rows(pair: Pair, columns: list[str]) -> DataFrame:
    return late.text_rows(pair.rows, {c: pair.text(c) for c in columns}, SIDE)


def _side_counts() -> list[Column]:
    return [F.count(on(BEFORE, F.lit(1))).alias("n_before"), F.count(on(AFTER, F.lit(1))).alias("n_after")]


def category_counts(pair: Pair, columns: list[str]) -> DataFrame:
    """(column, value, n_before, n_after) of the present values, compared as text."""
    return _category_rows(pair, columns).groupBy("column", "value").agg(*_side_counts())


def category_groups(pair: Pair, columns: list[str]) -> DataFrame:
    """The same counts with the hashes and beginnings of the values instead of the values."""
    return late.grouped(_category_rows(pair, columns), *_side_counts())


def category_shares(pair: Pair, columns: list[str] | None = None) -> DataFrame:
    """Share of every value among the present values of its column, before and after."""
    columns = columns if columns is not None else pair.categorical()
    return _with_shares(category_counts(pair, columns))


def _with_shares(counts: DataFrame) -> DataFrame:
    """The column totals are a table of one row per column and are broadcast; a
    window over the values of one column would put all of them into one task.
    """
    totals = counts.groupBy("column").agg(F.sum("n_before").alias("t_before"), F.sum("n_after").alias("t_after"))
    share = lambda n, t: F.coalesce(100 * F.try_divide(F.col(n).cast("double"), F.col(t)), F.lit(0.0))
    before, after = share("n_before", "t_before"), share("n_after", "t_after")
    return counts.join(F.broadcast(totals), "column").select(
        *[ref(c) for c in counts.columns],
        tidy(before, 2).alias("share_before"),
        tidy(after, 2).alias("share_after"),
        tidy(after - before, 2).alias("shift_pts"),
    )


def best_groups(shares: DataFrame, top_n: int) -> DataFrame:
    """The groups of values that can be among the first of their column and ``kind``, with equal beginnings at equal ranks."""
    kinds = {
        "shift": (None, [F.abs("shift_pts").desc()]),
        "new": (F.col("n_before") == 0, []),
        "dropped": (F.col("n_after") == 0, []),
    }
    chosen = None
    for kind, (test, order) in kinds.items():
        place = F.rank().over(Window.partitionBy("column").orderBy(*order, "beginning"))
        best = (shares if test is None else shares.filter(test)).withColumn("rank", place).filter(F.col("rank") <= top_n)
        best = best.withColumn("kind", F.lit(kind))
        chosen = best if chosen is None else chosen.unionByName(best)
    return chosen


def compare_categories(pair: Pair, columns: list[str] | None = None, top_n: int = TOP_SHIFTS) -> DataFrame:
    """Per shared category column the largest share shifts, the new and the dropped values.

    Rows ``(column, kind, rank, value, share_before, share_after, shift_pts)``.
    Values are counted and chosen by hash and beginning, so what is shuffled
    does not grow with their length; texts are fetched for the chosen. The rank
    filters become per-task group limits, so a column with very many values
    sends only its best few of each task to the ranking.
    """
    columns = columns if columns is not None else pair.categorical()
    if not columns:
        return small_table(pair.rows.sparkSession, [],
            "column string, kind string, rank int, value string, share_before double, share_after double, shift_pts double",
        )
    rows = _category_rows(pair, columns)
    shares = _with_shares(late.grouped(rows, *_side_counts()))
    chosen = best_groups(shares, top_n)
    found = late.with_values(chosen, rows)
    first = [F.when(F.col("kind") == "shift", F.abs("shift_pts")).desc_nulls_last(), F.col("value")]
    return (
        found.withColumn("rank", F.row_number().over(Window.partitionBy("column", "kind").orderBy(*first)))
        .filter(F.col("rank") <= top_n)
        .select("column", "kind", "rank", "value", "share_before", "share_after", "shift_pts")
    )


# ── drivers ──────────────────────────────────────────────────────────────────


def segment_aggregates(pair: Pair, metric: str, segment: str, agg: str = "sum") -> DataFrame:
    """(segment, before, after): sum or mean of the metric per present segment; an absent side is 0."""
    function = F.avg if agg == "mean" else F.sum
    value = pair.number(metric)
    zero = F.lit(0.0)
    return (
        pair.rows.select(SIDE, pair.text(segment).alias("segment"), value.alias("value"))
        .filter(F.col("segment").isNotNull())
        .groupBy("segment")
        .agg(
            F.coalesce(function(on(BEFORE, F.col("value"))), zero).alias("before"),
            F.coalesce(function(on(AFTER, F.col("value"))), zero).alias("after"),
        )
    )


def align_segments(agg_before: DataFrame, agg_after: DataFrame) -> DataFrame:
    """Two ready-made ``(segment, value)`` tables as one; a segment absent on one side is 0 there."""
    tag = lambda df, side: df.toDF("segment", "value").select(
        F.col("segment").cast("string"), F.col("value").cast("double"), F.lit(side).alias(SIDE)
    )
    rows = tag(agg_before, BEFORE).unionByName(tag(agg_after, AFTER))
    zero = F.lit(0.0)
    return rows.groupBy("segment").agg(
        F.coalesce(F.sum(on(BEFORE, F.col("value"))), zero).alias("before"),
        F.coalesce(F.sum(on(AFTER, F.col("value"))), zero).alias("after"),
    )


def decompose_totals(segments: DataFrame) -> DataFrame:
    """One row: totals over the segments, their change, and whether it is a mix shift.

    For means the totals are sums of segment means. A mix shift is a total that
    moves one way while less than half of the segments move with it.
    """
    delta = tidy(F.col("after") - F.col("before"), 4)
    sums = segments.agg(
        F.coalesce(F.sum("before"), F.lit(0.0)).alias("before"),
        F.coalesce(F.sum("after"), F.lit(0.0)).alias("after"),
        F.count("*").alias("n_segments"),
        F.count_if(delta > 0).alias("n_up"),
        F.count_if(delta < 0).alias("n_down"),
    )
    total_delta = F.col("after") - F.col("before")
    along = F.when(total_delta > 0, F.col("n_up")).otherwise(F.col("n_down"))
    return sums.select(
        tidy("before", 4).alias("total_before"),
        tidy("after", 4).alias("total_after"),
        tidy(total_delta, 4).alias("total_delta"),
        pct_change(F.col("before"), F.col("after")).alias("total_pct_change"),
        "n_segments",
        ((total_delta != 0) & (F.col("n_segments") > 1) & (along < F.col("n_segments") / 2)).alias("mix_shift"),
    )


def decompose_segments(segments: DataFrame) -> DataFrame:
    """Every segment with its change and its share of the total change, largest change first.

    The total is a scalar subquery over the same aggregate, whose shuffle Spark reuses.
    """
    delta = F.col("after") - F.col("before")
    total = segments.agg(F.sum("after") - F.sum("before")).scalar()
    return segments.select(
        "segment",
        tidy("before", 4).alias("before"),
        tidy("after", 4).alias("after"),
        tidy(delta, 4).alias("delta"),
        tidy(100 * F.try_divide(delta, total), 2).alias("contribution_pct"),
    ).orderBy(F.abs("delta").desc(), "segment")


def explain_driver(pair: Pair, metric: str, segment: str, agg: str = "sum") -> DataFrame:
    """Which segment drove the change of the metric: :func:`decompose_segments` of the raw rows."""
    return decompose_segments(segment_aggregates(pair, metric, segment, agg))


def driver_totals(pair: Pair, metric: str, segment: str, agg: str = "sum") -> DataFrame:
    return decompose_totals(segment_aggregates(pair, metric, segment, agg))


# ── default choices ──────────────────────────────────────────────────────────

_FEW, _MANY = 2, 20


def _low_cardinality(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with 2 to 20 distinct values: sketched first, counted only when that is close."""
    if not columns:
        return []
    clean = missing_as_null(df.select(*[ref(c) for c in columns]))
    row = clean.agg(*[F.approx_count_distinct(ref(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    close = [c for i, c in enumerate(columns) if row[f"d{i}"] <= 2 * _MANY]
    if not close:
        return []
    counted = {r["column"]: r["n_distinct"] for r in distinct_counts(clean, close).collect()}
    return [c for c in close if _FEW <= counted[c] <= _MANY]


def _first_choice(df: DataFrame, columns: list[str]) -> str | None:
    countable = [c for c in columns if not is_nested(df.schema[c].dataType)]
    few = _low_cardinality(df, countable)
    return next(iter([*few, *countable, *columns]), None)


def suggest_split_column(df: DataFrame) -> str | None:
    """First column with 2 to 20 distinct values, else the first that is not nested."""
    return _first_choice(df, df.columns)


def suggest_metric_column(pair: Pair, exclude: tuple[str, ...] = ()) -> str | None:
    """First shared number column that does not look like an identifier."""
    columns = [c for c in pair.numeric() if c not in exclude]
    return next(iter([*[c for c in columns if "id" not in c.lower()], *columns]), None)


def suggest_segment_column(pair: Pair, exclude: tuple[str, ...] = ()) -> str | None:
    """First shared category column with 2 to 20 distinct values before, else the first not nested."""
    columns = [c for c in pair.categorical() if c not in exclude]
    before = pair.rows.filter(F.col(SIDE) == BEFORE)
    return _first_choice(before, columns)


def suggest_user_column(df: DataFrame) -> str | None:
    """First column whose name speaks of users or identifiers."""
    return next((c for c in df.columns if "user" in c.lower() or "id" in c.lower()), None)
