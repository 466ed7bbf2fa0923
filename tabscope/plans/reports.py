"""Reports made of several operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.columns import require, small_table
from tabscope.operators import drift, trend
from tabscope.operators.drift import Pair
from tabscope.operators.significance import any_significant, categorical_significance, numeric_significance

HIGHLIGHT_METRICS = 5
HIGHLIGHT_SHIFTS = 3
HIGHLIGHT_DRIVERS = 5


def drift_report(
    pair: Pair,
    metric: str | None = None,
    segment: str | None = None,
    agg: str = "sum",
    exclude: tuple[str, ...] = (),
) -> Report:
    """Schema, metrics and categories; with ``metric`` and ``segment`` also drivers and tests."""
    shared = pair.shared()
    parts: dict[str, Callable[[], DataFrame]] = {
        "schema": lambda: drift.compare_schemas(pair),
        "metrics": lambda: drift.compare_metrics(pair, [c for c in pair.numeric() if c not in exclude]),
        "categories": lambda: drift.compare_categories(pair, [c for c in pair.categorical() if c not in exclude]),
    }
    if metric and segment:
        segments = drift.segment_aggregates(pair, metric, segment, agg)
        parts["driver"] = lambda: drift.decompose_segments(segments)
        parts["driver_totals"] = lambda: drift.decompose_totals(segments)
    if metric and metric in shared:
        parts["metric_significance"] = lambda: numeric_significance(pair, metric)
    if segment and segment in shared:
        parts["segment_significance"] = lambda: categorical_significance(pair, segment)
    return Report(parts)


class Report(Mapping[str, DataFrame]):
    """The tables of a report by name, each built when it is first asked for."""

    def __init__(self, parts: dict[str, Callable[[], DataFrame]]):
        self._parts = parts
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._parts[name]()
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._parts

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def has_significant_change(report: Mapping[str, DataFrame]) -> DataFrame:
    """One row ``(significant)`` over the tests of a report."""
    tests = [report[k] for k in ("metric_significance", "segment_significance") if k in report]
    if not tests:
        return small_table(report["schema"].sparkSession, [(False,)], "significant boolean")
    return any_significant(*tests)


def compare_groups(
    df: DataFrame, split: str, value_before: Any, value_after: Any, metric: str | None = None, segment: str | None = None
) -> Mapping[str, DataFrame]:
    """Drift report between two values of one column of one table.

    An unknown column or a value without rows gives ``{"error": one-row table}``.
    """
    error = lambda text: {"error": small_table(df.sparkSession, [(text,)], "reason string")}
    if split not in df.columns:
        return error(f"unknown column: {split}")
    pair = drift.split_by_column(df, split, value_before, value_after)
    for side, value in ((drift.BEFORE, value_before), (drift.AFTER, value_after)):
        if pair.rows.filter(F.col(drift.SIDE) == side).isEmpty():
            return error(f"no rows with {split} = {value!r}")
    return drift_report(pair, metric, segment, exclude=(split,))


def drift_highlights(report: Mapping[str, DataFrame]) -> DataFrame:
    """What a reader should see first: ``(kind, subject, detail, before, after, change)``."""
    nothing = F.lit(None)

    def lines(rows: DataFrame, kind: str, subject, detail=nothing, before=nothing, after=nothing, change=nothing):
        return rows.select(
            F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"),
            before.cast("double").alias("before"), after.cast("double").alias("after"),
            change.cast("double").alias("change"),
        )

    c = F.col
    schema, metrics, categories = report["schema"], report["metrics"], report["categories"]
    counts = schema.filter("kind = 'row_count'")
    result = lines(counts, "row_count", F.lit("rows"), before=c("before"), after=c("after"), change=c("pct_change"))
    changed = schema.filter(c("kind").isin("added_column", "removed_column", "dtype_change"))
    moved = metrics.filter("sum_pct_change <> 0").orderBy(F.abs("sum_pct_change").desc(), "column")
    parts = [
        changed.select(
            "kind", c("column").alias("subject"), F.concat_ws(" to ", "before", "after").alias("detail"),
            *[nothing.cast("double").alias(x) for x in ("before", "after", "change")],
        ),
        lines(moved.limit(HIGHLIGHT_METRICS), "metric", c("column"), before=c("sum_before"), after=c("sum_after"),
              change=c("sum_pct_change")),
        lines(categories.filter((c("kind") != "shift") | (c("rank") <= HIGHLIGHT_SHIFTS)), "category", c("column"),
              F.concat_ws(": ", "kind", "value"), c("share_before"), c("share_after"), c("shift_pts")),
    ]
    if "driver" in report:
        top = report["driver"].orderBy(F.abs("delta").desc(), "segment").limit(HIGHLIGHT_DRIVERS)
        parts.append(lines(report["driver_totals"], "total", F.lit("all segments"),
                           F.when(c("mix_shift"), "mix shift"), c("total_before"), c("total_after"), c("total_pct_change")))
        parts.append(lines(top, "driver", c("segment"), c("contribution_pct"), c("before"), c("after"), c("delta")))
    for name, subject in (("metric_significance", "metric"), ("segment_significance", "column")):
        if name in report:
            verdict = F.when(c("significant"), "significant").otherwise("not significant")
            parts.append(lines(report[name].filter("applicable"), "test", c(subject), verdict, change=c("p_value")))
    for part in parts:
        result = result.unionByName(part)
    return result


def analyze_trend(
    df: DataFrame, date: str, metric: str, agg: str = "sum", forecast_days: int = trend.FORECAST_DAYS, by: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Summary, weekday effects, forecast and history of a daily metric, per combination of the ``by`` columns if there are any.

    ``fitted`` is one row per calendar day and series; persist it if several tables are read.
    """
    require(df, date, metric, *by)
    daily = trend.daily_series(df, date, metric, agg, by)
    fitted = trend.fit_trend(daily, by)
    return {
        "fitted": fitted,
        "summary": trend.trend_summary(fitted, by),
        "weekday_effect": trend.weekday_effects(fitted, by),
        "forecast": trend.forecast(fitted, forecast_days, by),
        "history": trend.history(daily, by),
    }
