"""Queries on retention, trend and forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import EVENTS_GAPS, Derived, query, rounded
from tabscope.columns import small_table
from tabscope.functions.safe import tidy
from tabscope.operators import cleaning, cohort, trend
from tabscope.plans.reports import analyze_trend

# ── retention ────────────────────────────────────────────────────────────────

_PERIOD = {
    "D": ("CAST({d} AS DATE)", "date_diff('day', cohort, period)", "CAST(cohort AS VARCHAR)"),
    "W": (
        "CAST(date_trunc('week', {d}) AS DATE)",
        "date_diff('day', cohort, period) // 7",
        "concat(CAST(cohort AS VARCHAR), '/', CAST(CAST(cohort + INTERVAL 6 DAY AS DATE) AS VARCHAR))",
    ),
    "M": (
        "CAST(date_trunc('month', {d}) AS DATE)",
        "(year(period) - year(cohort)) * 12 + month(period) - month(cohort)",
        "strftime(cohort, '%Y-%m')",
    ),
}


def retention_sql(table: str, user: str, date: str, period: str) -> str:
    start, offset, label = _PERIOD[period]
    return f"""WITH v AS (SELECT DISTINCT {user} AS u, {start.format(d=date)} AS period FROM {table}
      WHERE {user} IS NOT NULL AND {date} IS NOT NULL),
    f AS (SELECT *, min(period) OVER (PARTITION BY u) AS cohort FROM v),
    a AS (SELECT cohort, CAST({offset} AS INTEGER) AS o, count(DISTINCT u) AS n FROM f GROUP BY 1, 2),
    s AS (SELECT cohort, count(DISTINCT u) AS size FROM f GROUP BY 1)
    SELECT true AS applicable, CAST(NULL AS VARCHAR) AS reason, {label.replace('cohort', 'a.cohort')} AS cohort,
      o AS period_offset, n AS active, size AS cohort_size, {rounded('CAST(n AS DOUBLE) / size', 4)} AS retention
    FROM a JOIN s ON a.cohort = s.cohort"""


# Customers and the days of their orders: dates in two spellings, some of them no dates at all.
VISITS = Derived(
    "orders",
    (
        "o_custkey",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))"
        " WHEN o_orderkey % 31 = 1 THEN 'lost' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS seen",
        "CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 31 = 1 THEN NULL ELSE o_orderdate END AS seen_at",
    ),
)


@query("l1_retention_day", retention_sql("events", "user_id", "ts", "D"))
def by_day(t):
    """Every event; where all users begin on one day, the curve of that one cohort."""
    return cohort.compute_retention(t.events, "user_id", "ts", "D", min_cohorts=1)


@query("l1_retention_day_of_orders", retention_sql(VISITS.sql, "o_custkey", "seen_at", "D"))
def by_day_of_orders(t):
    return cohort.compute_retention(t.derived(VISITS), "o_custkey", "seen_at", "D")


@query("l1_retention_week", retention_sql(VISITS.sql, "o_custkey", "seen_at", "W"))
def by_week(t):
    """Dates here are text in mixed spellings."""
    return cohort.compute_retention(t.derived(VISITS), "o_custkey", "seen", "W")


@query("l1_retention_month", retention_sql("orders", "o_custkey", "o_orderdate", "M"))
def by_month(t):
    return cohort.compute_retention(t.orders, "o_custkey", "o_orderdate", "M")


def _matrix_sql(offsets: range) -> str:
    cells = ", ".join(f"max(CASE WHEN period_offset = {n} THEN retention END) AS offset_{n}" for n in offsets)
    return f"SELECT cohort, cohort_size, {cells} FROM ({retention_sql(VISITS.sql, 'o_custkey', 'seen_at', 'M')}) GROUP BY 1, 2"


@query("l2_retention_matrix", _matrix_sql(range(24)))
def matrix(t):
    """The first two years of every cohort."""
    retention = cohort.compute_retention(t.derived(VISITS), "o_custkey", "seen", "M")
    return cohort.retention_matrix(retention.filter("period_offset < 24"))


# ── trend ────────────────────────────────────────────────────────────────────


def daily_sql(table: str, date: str, metric: str, agg: str) -> str:
    return f"""(SELECT day, value, date_diff('day', min(day) OVER (), day) AS x FROM
      (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM
        (SELECT CAST(min({date}) AS DATE) AS a, CAST(max({date}) AS DATE) AS b FROM {table} WHERE {metric} IS NOT NULL)) c
      LEFT JOIN (SELECT CAST({date} AS DATE) AS day, {agg}({metric}) AS value FROM {table} WHERE {metric} IS NOT NULL GROUP BY 1) v
      USING (day))"""


def fitted_sql(table: str, date: str, metric: str, agg: str) -> str:
    return f"""(SELECT *, avg(residual) OVER (PARTITION BY weekday) AS effect FROM
      (SELECT *, value - (i + s * x) AS residual, isodow(day) - 1 AS weekday FROM {daily_sql(table, date, metric, agg)},
        (SELECT count(value) AS n, regr_slope(value, x) AS s, regr_intercept(value, x) AS i
         FROM {daily_sql(table, date, metric, agg)} WHERE value IS NOT NULL)))"""


_ORDERS = ("orders", "o_orderdate", "o_totalprice", "sum")
_EVENTS = (EVENTS_GAPS.sql, "ts", "value", "avg")


def _daily(table):
    return table.withColumn("day", F.col("day").cast("string")).withColumn("value", tidy("value", 4))


def _daily_check(name: str, source: tuple) -> str:
    return f"SELECT CAST(day AS VARCHAR) AS day, {rounded('value', 4)} AS value FROM {daily_sql(*source)}"


@query("m1_daily_sum", _daily_check("sum", _ORDERS))
def daily_sum(t):
    return _daily(trend.daily_series(t.orders, "o_orderdate", "o_totalprice"))


@query("m1_daily_mean", _daily_check("mean", _EVENTS))
def daily_mean(t):
    return _daily(trend.daily_series(t.derived(EVENTS_GAPS), "ts", "value", "mean"))


# Days of the week without orders leave gaps in the calendar.
WEEKDAYS = Derived(
    "orders",
    (
        "CASE WHEN day(o_orderdate) IN (1, 2, 15) THEN NULL ELSE o_totalprice END AS price",
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS ordered",
        "o_orderdate",
    ),
)


@query("c8_calendar_gaps", _daily_check("gaps", (WEEKDAYS.sql, "o_orderdate", "price", "sum")))
def gaps(t):
    return _daily(trend.daily_series(t.derived(WEEKDAYS), "ordered", "price"))


def _summary_sql(source: tuple) -> str:
    return f"""SELECT true AS applicable, CAST(NULL AS VARCHAR) AS reason, n AS n_days, {rounded('s', 6)} AS slope_per_day,
      CASE WHEN s > 0 THEN 'rising' WHEN s < 0 THEN 'falling' ELSE 'flat' END AS trend_direction,
      {rounded('100.0 * s * (n - 1) / i', 2)} AS trend_pct_over_period, swing > 0.15 * spread AS has_weekly_seasonality,
      {rounded('std', 4)} AS forecast_std
    FROM (SELECT any_value(n) AS n, any_value(s) AS s, any_value(i) AS i, stddev_pop(residual) AS std,
      stddev_pop(value) AS spread, max(effect) - min(effect) AS swing FROM {fitted_sql(*source)})"""


@query("m2_m4_m7_trend_summary", _summary_sql(_ORDERS))
def trend_of_orders(t):
    return analyze_trend(t.orders, "o_orderdate", "o_totalprice")["summary"]


@query("m2_trend_summary_mean", _summary_sql(_EVENTS))
def trend_of_events(t):
    return analyze_trend(t.derived(EVENTS_GAPS), "ts", "value", "mean")["summary"]


@query("m2_trend_summary_gaps", _summary_sql((WEEKDAYS.sql, "o_orderdate", "price", "sum")))
def trend_with_gaps(t):
    return analyze_trend(t.derived(WEEKDAYS), "ordered", "price")["summary"]


@query(
    "m3_weekday_effect",
    f"SELECT CAST(weekday AS INTEGER) AS weekday, strftime(min(day), '%A') AS day_name, {rounded('max(effect)', 2)} AS effect"
    f" FROM {fitted_sql(*_ORDERS)} GROUP BY 1",
)
def weekdays(t):
    return analyze_trend(t.orders, "o_orderdate", "o_totalprice")["weekday_effect"]


def _forecast_sql(source: tuple, days: int) -> str:
    value = rounded("i + s * (last_x + k) + coalesce(e.effect, 0)", 4)
    return f"""WITH f AS (SELECT * FROM {fitted_sql(*source)}), e AS (SELECT weekday, max(effect) AS effect FROM f GROUP BY 1),
    o AS (SELECT max(day) AS last_day, max(x) AS last_x, any_value(s) AS s, any_value(i) AS i, {rounded('stddev_pop(residual)', 4)} AS std FROM f),
    d AS (SELECT *, CAST(last_day + k * INTERVAL 1 DAY AS DATE) AS day FROM o, range(1, {days + 1}) r(k))
    SELECT CAST(day AS VARCHAR) AS day, value, {rounded('value - 1.28 * std', 4)} AS lower, {rounded('value + 1.28 * std', 4)} AS upper
    FROM (SELECT day, std, {value} AS value FROM d LEFT JOIN e ON e.weekday = isodow(day) - 1)"""


@query("m5_m6_forecast", _forecast_sql(_ORDERS, 14))
def forecast(t):
    table = analyze_trend(t.orders, "o_orderdate", "o_totalprice")["forecast"]
    return table.withColumn("day", F.col("day").cast("string"))


@query("m5_forecast_mean", _forecast_sql(_EVENTS, 30))
def forecast_events(t):
    table = analyze_trend(t.derived(EVENTS_GAPS), "ts", "value", "mean", forecast_days=30)["forecast"]
    return table.withColumn("day", F.col("day").cast("string"))


# ── many series at once ──────────────────────────────────────────────────────


def daily_by_sql(table: str, date: str, metric: str, agg: str, key: str) -> str:
    return f"""(SELECT c.k, day, value, date_diff('day', min(day) OVER (PARTITION BY c.k), day) AS x FROM
      (SELECT k, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM
        (SELECT {key} AS k, CAST(min({date}) AS DATE) AS a, CAST(max({date}) AS DATE) AS b FROM {table} WHERE {metric} IS NOT NULL GROUP BY 1)) c
      LEFT JOIN (SELECT {key} AS k, CAST({date} AS DATE) AS on_day, {agg}({metric}) AS value FROM {table} WHERE {metric} IS NOT NULL GROUP BY 1, 2) v
      ON v.k IS NOT DISTINCT FROM c.k AND on_day = day)"""


def fitted_by_sql(*source: str) -> str:
    daily = daily_by_sql(*source)
    return f"""(SELECT *, avg(residual) OVER (PARTITION BY k, weekday) AS effect FROM
      (SELECT d.*, n, s, i, value - (i + s * x) AS residual, isodow(day) - 1 AS weekday FROM {daily} d JOIN
        (SELECT k, count(value) AS n, regr_slope(value, x) AS s, regr_intercept(value, x) AS i FROM {daily} WHERE value IS NOT NULL GROUP BY 1) l
        ON l.k IS NOT DISTINCT FROM d.k))"""


_BY_STATUS = ("orders", "o_orderdate", "o_totalprice", "sum", "o_orderstatus")
_BY_LABEL = (EVENTS_GAPS.sql, "ts", "value", "avg", "label")
_BY_USER = ("events", "ts", "value", "sum", "user_id")


@query("m1_daily_by_status", f"SELECT k AS o_orderstatus, CAST(day AS VARCHAR) AS day, {rounded('value', 4)} AS value FROM {daily_by_sql(*_BY_STATUS)}")
def daily_by_status(t):
    return _daily(trend.daily_series(t.orders, "o_orderdate", "o_totalprice", by=["o_orderstatus"]))


def _summary_by_sql(key: str, *source: str) -> str:
    enough = "CASE WHEN n >= 10 THEN {} END"
    found = {
        "slope_per_day": rounded("s", 6),
        "trend_direction": "CASE WHEN s > 0 THEN 'rising' WHEN s < 0 THEN 'falling' ELSE 'flat' END",
        "trend_pct_over_period": f"CASE WHEN i <> 0 THEN {rounded('100.0 * s * (n - 1) / i', 2)} END",
        "has_weekly_seasonality": "swing > 0.15 * spread",
        "forecast_std": rounded("std", 4),
    }
    columns = ", ".join(f"{enough.format(sql)} AS {name}" for name, sql in found.items())
    return f"""SELECT k AS {key}, n >= 10 AS applicable, CASE WHEN n < 10 THEN 'at least 10 distinct days are needed' END AS reason, n AS n_days, {columns}
    FROM (SELECT k, any_value(n) AS n, any_value(s) AS s, any_value(i) AS i, stddev_pop(residual) AS std,
      stddev_pop(value) AS spread, max(effect) - min(effect) AS swing FROM {fitted_by_sql(*source)} GROUP BY k)"""


@query("m2_trend_by_status", _summary_by_sql("o_orderstatus", *_BY_STATUS))
def trend_by_status(t):
    return analyze_trend(t.orders, "o_orderdate", "o_totalprice", by=["o_orderstatus"])["summary"]


@query("m2_trend_by_label", _summary_by_sql("label", *_BY_LABEL))
def trend_by_label(t):
    """Events without a label are a series too."""
    return analyze_trend(t.derived(EVENTS_GAPS), "ts", "value", "mean", by=["label"])["summary"]


@query(
    "m3_weekday_effect_by_status",
    f"SELECT k AS o_orderstatus, CAST(weekday AS INTEGER) AS weekday, strftime(min(day), '%A') AS day_name, {rounded('max(effect)', 2)} AS effect"
    f" FROM {fitted_by_sql(*_BY_STATUS)} WHERE n >= 10 GROUP BY 1, 2 HAVING max(effect) IS NOT NULL",
)
def weekdays_by_status(t):
    return analyze_trend(t.orders, "o_orderdate", "o_totalprice", by=["o_orderstatus"])["weekday_effect"]


def _forecast_by_sql(key: str, days: int, *source: str) -> str:
    value = rounded("i + s * (last_x + step) + coalesce(e.effect, 0)", 4)
    return f"""WITH f AS (SELECT * FROM {fitted_by_sql(*source)} WHERE n >= 10), e AS (SELECT k, weekday, max(effect) AS effect FROM f GROUP BY 1, 2),
    o AS (SELECT k, max(day) AS last_day, max(x) AS last_x, any_value(s) AS s, any_value(i) AS i, {rounded('stddev_pop(residual)', 4)} AS std FROM f GROUP BY 1),
    d AS (SELECT *, CAST(last_day + step * INTERVAL 1 DAY AS DATE) AS day FROM o, range(1, {days + 1}) r(step))
    SELECT k AS {key}, CAST(day AS VARCHAR) AS day, value, {rounded('value - 1.28 * std', 4)} AS lower, {rounded('value + 1.28 * std', 4)} AS upper
    FROM (SELECT d.k, day, std, {value} AS value FROM d LEFT JOIN e ON e.weekday = isodow(day) - 1 AND e.k IS NOT DISTINCT FROM d.k)"""


@query("m5_forecast_by_status", _forecast_by_sql("o_orderstatus", 14, *_BY_STATUS))
def forecast_by_status(t):
    table = analyze_trend(t.orders, "o_orderdate", "o_totalprice", by=["o_orderstatus"])["forecast"]
    return table.withColumn("day", F.col("day").cast("string"))


@query("m5_forecast_by_user", _forecast_by_sql("user_id", 7, *_BY_USER))
def forecast_by_user(t):
    """A series per user, many of them with too few days."""
    table = analyze_trend(t.events, "ts", "value", forecast_days=7, by=["user_id"])["forecast"]
    return table.withColumn("day", F.col("day").cast("string"))


@query("m8_date_columns", "SELECT c AS \"column\" FROM (VALUES ('ordered'), ('o_orderdate')) v(c) WHERE (SELECT count(*) FROM orders) > 0")
def date_columns(t):
    found = cleaning.date_columns(t.derived(WEEKDAYS))
    return small_table(t.spark, [(c,) for c in found], "column string")
