"""Linear trend, weekly pattern and short forecast of a daily metric, of one series or of many.

The rows are aggregated to one row per day first. From there on a series is as
long as its calendar, so its windows are small. With ``by``, each combination
of those columns is a series of its own, with its own first and last day; a
null is a key like any other. All windows and sums are then per key, so a
million series are spread over the cluster; a key with very many rows is down
to one row per day before it meets a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tabscope.columns import missing_as_null, ref, require
from tabscope.functions.dates import day_rows
from tabscope.functions.safe import share_pct, tidy

MIN_DAYS = 10
FORECAST_DAYS = 14
# Share of the metric's spread that makes weekdays matter; half width of an 80 % band.
SEASONAL_SHARE = 0.15
BAND = 1.28


# Columns of the tables of one series; keys cannot have these names.
OWN_COLUMNS = {
    "day", "value", "on_day", "last", "x", "n_days", "slope", "intercept", "fitted", "residual", "weekday", "effect",
    "day_name", "applicable", "reason", "slope_per_day", "trend_direction", "trend_pct_over_period",
    "has_weekly_seasonality", "forecast_std", "lower", "upper", "step", "std", "effects", "last_day", "last_x",
    "n", "start", "residual_spread", "spread", "swing",
}


def _keys(by: Sequence[str]) -> list[Column]:
    return [ref(k) for k in by]


def _all_days(by: Sequence[str]) -> WindowSpec:
    """All rows of a series, which are no more than the days of its calendar."""
    return Window.partitionBy(*_keys(by))


def daily_series(df: DataFrame, date: str, metric: str, agg: str = "sum", by: Sequence[str] = ()) -> DataFrame:
    """(keys, day, value) for every day of a series from first to last; days without data are null.

    A day is stretched up to the next one that has data, so no second pass and
    no join with a calendar is needed.
    """
    require(df, date, metric, *by)
    if clash := OWN_COLUMNS & set(by):
        raise ValueError(f"rename these columns to use them as keys: {sorted(clash)}")
    value = ref(metric)
    if df.schema[metric].dataType.typeName() == "boolean":
        value = value.cast("int")
    rows = missing_as_null(day_rows(df, date, value=value.cast("double"), **{k: ref(k) for k in by})).na.drop(subset=["day", "value"])
    function = F.avg if agg == "mean" else F.sum
    days = rows.groupBy(*_keys(by), "day").agg(function("value").alias("value"))
    last = F.coalesce(F.date_sub(F.lead("day").over(_all_days(by).orderBy("day")), 1), F.col("day"))
    return days.withColumn("last", last).select(
        *_keys(by), F.explode(F.sequence("day", "last")).alias("on_day"), "day", "value"
    ).select(*_keys(by), F.col("on_day").alias("day"), F.when(F.col("on_day") == F.col("day"), F.col("value")).alias("value"))


def fit_trend(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The daily rows with the least-squares line through them and what the line leaves over.

    Adds ``x`` (calendar days from the first), ``n_days`` (days with data),
    ``slope``, ``intercept``, ``fitted``, ``residual``, ``weekday`` (Monday = 0),
    ``effect`` (mean residual of the weekday).
    """
    x = F.datediff("day", F.min("day").over(_all_days(by)))
    rows = daily.withColumn("x", x)
    observed = F.when(F.col("value").isNotNull(), F.col("x").cast("double"))
    rows = (
        rows.withColumn("n_days", F.count("value").over(_all_days(by)))
        .withColumn("slope", F.regr_slope(F.col("value"), observed).over(_all_days(by)))
        .withColumn("intercept", F.regr_intercept(F.col("value"), observed).over(_all_days(by)))
        .withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("x"))
        .withColumn("residual", F.col("value") - F.col("fitted"))
        .withColumn("weekday", F.weekday("day"))
    )
    return rows.withColumn("effect", F.avg("residual").over(Window.partitionBy(*_keys(by), "weekday")))


def weekday_effects(fitted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        fitted.filter((F.col("n_days") >= MIN_DAYS) & F.col("effect").isNotNull())
        .groupBy(*_keys(by), "weekday")
        .agg(F.date_format(F.min("day"), "EEEE").alias("day_name"), tidy(F.max("effect"), 2).alias("effect"))
        .orderBy(*_keys(by), "weekday")
    )


def trend_summary(fitted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per series: slope, direction, change over the period, weekly pattern, residual spread."""
    c = F.col
    one = fitted.groupBy(*_keys(by)).agg(
        F.coalesce(F.max("n_days"), F.lit(0)).alias("n"),
        F.max("slope").alias("slope"),
        F.max("intercept").alias("start"),
        F.stddev_pop("residual").alias("residual_spread"),
        F.stddev_pop("value").alias("spread"),
        (F.max("effect") - F.min("effect")).alias("swing"),
    )
    usable = c("n") >= MIN_DAYS
    direction = F.when(c("slope") > 0, "rising").when(c("slope") < 0, "falling").otherwise("flat")
    # The first day always has data, so the line at the first observed day is the intercept.
    change = share_pct(c("slope") * (c("n") - 1), c("start"))
    found = {
        "slope_per_day": tidy("slope", 6),
        "trend_direction": direction,
        "trend_pct_over_period": F.when(c("start") != 0, change),
        "has_weekly_seasonality": c("swing") > SEASONAL_SHARE * c("spread"),
        "forecast_std": tidy("residual_spread", 4),
    }
    return one.select(
        *_keys(by),
        usable.alias("applicable"),
        F.when(~usable, f"at least {MIN_DAYS} distinct days are needed").alias("reason"),
        c("n").alias("n_days"),
        *[F.when(usable, value).alias(name) for name, value in found.items()],
    )


def forecast(fitted: DataFrame, days: int = FORECAST_DAYS, by: Sequence[str] = ()) -> DataFrame:
    """(keys, day, value, lower, upper) of the next days: line plus weekday effect, with an 80 % band."""
    one = fitted.filter(F.col("n_days") >= MIN_DAYS).groupBy(*_keys(by)).agg(
        F.max("day").alias("last_day"),
        F.max("x").alias("last_x"),
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        tidy(F.stddev_pop("residual"), 4).alias("std"),
        # One entry per weekday seen, seven at most.
        F.map_from_entries(F.collect_set(F.when(F.col("effect").isNotNull(), F.struct("weekday", "effect")))).alias(
            "effects"
        ),
    )
    one = one.filter("last_day is not null")
    steps = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("step"))
    day = F.date_add("last_day", F.col("step"))
    line = F.col("intercept") + F.col("slope") * (F.col("last_x") + F.col("step"))
    value = tidy(line + F.coalesce(F.try_element_at("effects", F.weekday(day)), F.lit(0.0)), 4)
    return steps.select(
        *_keys(by),
        day.alias("day"),
        value.alias("value"),
        tidy(value - BAND * F.col("std"), 4).alias("lower"),
        tidy(value + BAND * F.col("std"), 4).alias("upper"),
    )


def history(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return daily.select(*_keys(by), "day", tidy("value", 4).alias("value")).orderBy(*_keys(by), "day")
