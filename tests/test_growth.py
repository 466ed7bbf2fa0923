import datetime
import random

import pytest
from pyspark.sql import functions as F

from tabscope.operators import cohort, trend
from tabscope.plans.reports import analyze_trend
from tests.conftest import as_dicts, by

LOG = [
    (11, "2022-09-03"), (11, "2022-09-20"), (11, "2022-11-05"), (12, "2022-09-28"), (12, "2022-10-01"), (13, "2022-10-10"),
    (14, "2022-10-12"), (14, "2022-11-24"), (15, "2022-09-01"), (16, "2022-09-15"),
]


@pytest.fixture(scope="module")
def log(table):
    return table("user_id int, event_date string", LOG)


def test_retention_by_month(log):
    rows = as_dicts(cohort.compute_retention(log, "user_id", "event_date", "M"))
    assert all(r["applicable"] for r in rows)
    found = {(r["cohort"], r["period_offset"]): (r["cohort_size"], r["retention"]) for r in rows}
    assert found == {
        ("2022-09", 0): (4, 1.0), ("2022-09", 1): (4, 0.25), ("2022-09", 2): (4, 0.25),
        ("2022-10", 0): (2, 1.0), ("2022-10", 1): (2, 0.5),
    }


def test_matrix_leaves_the_unseen_empty(log):
    rows = by(cohort.retention_matrix(cohort.compute_retention(log, "user_id", "event_date", "M")), "cohort")
    assert [rows["2022-09"][f"offset_{n}"] for n in range(3)] == [1.0, 0.25, 0.25]
    assert [rows["2022-10"][f"offset_{n}"] for n in range(3)] == [1.0, 0.5, None]


def test_a_single_cohort_is_shown_where_asked_for(table):
    df = table("u int, d string", [(1, "2024-01-01"), (2, "2024-01-01"), (2, "2024-01-03")])
    rows = as_dicts(cohort.compute_retention(df, "u", "d", "D", min_cohorts=1))
    assert sorted((r["applicable"], r["cohort"], r["period_offset"], r["active"], r["cohort_size"], r["retention"]) for r in rows) == [
        (True, "2024-01-01", 0, 2, 2, 1.0), (True, "2024-01-01", 2, 1, 2, 0.5),
    ]
    assert [r["applicable"] for r in as_dicts(cohort.compute_retention(df, "u", "d", "D"))] == [False]


def test_weeks_start_on_monday(table):
    df = table("u int, d string", [(1, "2024-01-01"), (1, "2024-01-08"), (2, "2024-01-14"), (2, "2024-01-15")])
    rows = as_dicts(cohort.compute_retention(df, "u", "d", "W"))
    assert {r["cohort"] for r in rows} == {"2024-01-01/2024-01-07", "2024-01-08/2024-01-14"}
    assert sorted((r["cohort"][:10], r["period_offset"]) for r in rows) == [("2024-01-01", 0), ("2024-01-01", 1), ("2024-01-08", 0), ("2024-01-08", 1)]


def test_month_offsets_cross_years(table):
    df = table("u int, d string", [(1, "2023-11-30"), (1, "2024-02-01"), (2, "2023-12-01")])
    rows = as_dicts(cohort.compute_retention(df, "u", "d", "M"))
    assert {r["period_offset"] for r in rows if r["cohort"] == "2023-11"} == {0, 3}


@pytest.mark.parametrize(
    "rows, word",
    [([(1, "2024-01-01"), (1, "2024-02-01")], "users"), ([(1, "2024-01-01"), (2, "2024-01-02")], "periods"), ([(1, "x"), (None, "2024-01-01")], "users")],
)
def test_retention_does_not_apply(table, rows, word):
    found = as_dicts(cohort.compute_retention(table("u int, d string", rows), "u", "d", "M"))
    assert len(found) == 1 and found[0]["applicable"] is False and word in found[0]["reason"]
    with pytest.raises(ValueError):
        cohort.compute_retention(table("u int, d string", rows), "u", "d", "Q")


def days(count, value, start=datetime.date(2024, 1, 1)):
    return [(start + datetime.timedelta(days=i), float(value(i, (start + datetime.timedelta(days=i)).weekday()))) for i in range(count)]


@pytest.fixture(scope="module")
def rising(table):
    rng = random.Random(7)
    return table("d date, v double", days(98, lambda i, w: 40 + 1.5 * i + (12 if w == 2 else 0) + rng.gauss(0, 1)))


def test_rising_trend_with_weekly_pattern(rising):
    found = analyze_trend(rising, "d", "v")
    summary = as_dicts(found["summary"])[0]
    assert summary["applicable"] and summary["n_days"] == 98
    assert summary["trend_direction"] == "rising" and summary["has_weekly_seasonality"]
    assert summary["slope_per_day"] == pytest.approx(1.5, abs=0.05)
    effects = {r["day_name"]: r["effect"] for r in as_dicts(found["weekday_effect"])}
    assert len(effects) == 7 and effects["Friday"] < effects["Wednesday"]
    forecast = as_dicts(found["forecast"])
    assert len(forecast) == 14 and min(r["day"] for r in forecast) == datetime.date(2024, 4, 8)
    assert all(r["lower"] < r["value"] < r["upper"] for r in forecast)
    wednesday = next(r for r in forecast if r["day"].weekday() == 2)
    friday = next(r for r in forecast if r["day"] > wednesday["day"] and r["day"].weekday() == 4)
    assert friday["value"] < wednesday["value"]
    assert found["history"].count() == 98


def test_falling_and_flat(table):
    falling = as_dicts(analyze_trend(table("d date, v double", days(42, lambda i, w: 90 - 54 * i / 41)), "d", "v")["summary"])[0]
    assert falling["trend_direction"] == "falling" and falling["trend_pct_over_period"] == -60.0
    flat = as_dicts(analyze_trend(table("d date, v double", days(14, lambda i, w: 7)), "d", "v")["summary"])[0]
    assert flat["trend_direction"] == "flat" and flat["has_weekly_seasonality"] is False


def test_daily_sum_and_mean(table):
    df = table("d date, v double", [(datetime.date(2022, 7, 1) + datetime.timedelta(days=i // 3), 4.5) for i in range(36)])
    assert {r["value"] for r in as_dicts(trend.daily_series(df, "d", "v"))} == {13.5}
    assert {r["value"] for r in as_dicts(trend.daily_series(df, "d", "v", "mean"))} == {4.5}


def test_gaps_are_days_without_a_value(table):
    df = table("d string, v double", [("2024-01-01", 1.0), ("1/4/2024", 4.0), ("never", 9.0), ("2024-01-02", None)])
    rows = {str(r["day"]): r["value"] for r in as_dicts(trend.daily_series(df, "d", "v"))}
    assert rows == {"2024-01-01": 1.0, "2024-01-02": None, "2024-01-03": None, "2024-01-04": 4.0}


def test_too_few_days(table):
    found = analyze_trend(table("d date, v double", days(9, lambda i, w: i)), "d", "v")
    summary = as_dicts(found["summary"])[0]
    assert summary["applicable"] is False and summary["reason"] and summary["slope_per_day"] is None
    assert found["forecast"].count() == 0 and found["weekday_effect"].count() == 0
    empty = analyze_trend(table("d date, v double", []), "d", "v")
    assert as_dicts(empty["summary"])[0]["applicable"] is False and empty["history"].count() == 0


def test_hot_user_is_reduced_before_the_window(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("u"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("d"),
    )
    retention = cohort.compute_retention(rows, "u", "d", "W")
    plan = retention._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("HashAggregate")  # the plan reads from the result down
    assert sum(r["active"] for r in as_dicts(retention) if r["period_offset"] == 0) == 50


def test_many_series_are_each_as_one(spark, table):
    """Each key gives what its rows alone give; keys may be null, short, or have a third of all rows."""
    rng = random.Random(3)
    series = {"a": days(40, lambda i, w: 5 + i + 3 * (w == 1)), "b": days(12, lambda i, w: rng.gauss(0, 1), datetime.date(2023, 3, 1)), None: days(15, lambda i, w: 7), "c": days(4, lambda i, w: i)}
    rows = [(k, n, d, v) for k, r in series.items() for n in (1, 2) for d, v in r] + [("a", 1, datetime.date(2024, 1, 3), 0.0)] * 60
    df = table("k string, m int, d date, v double", rows)
    found = analyze_trend(df, "d", "v", by=["k", "m"])
    for part in ("summary", "weekday_effect", "forecast", "history"):
        many = [tuple(r) for r in found[part].collect()]
        for k in series:
            for n in (1, 2):
                alone = [tuple(r) for r in analyze_trend(df.where((F.col("k").eqNullSafe(k)) & (F.col("m") == n)), "d", "v")[part].collect()]
                assert sorted(r[2:] for r in many if r[:2] == (k, n)) == sorted(alone), (part, k, n)
    assert found["summary"].count() == 8 and found["forecast"].where("k = 'c'").count() == 0


def test_series_of_nothing_and_clashing_keys(table):
    empty = analyze_trend(table("k string, d date, v double", []), "d", "v", by=["k"])
    assert all(empty[part].count() == 0 for part in ("summary", "weekday_effect", "forecast", "history"))
    with pytest.raises(ValueError, match="day"):
        trend.daily_series(table("day string, d date, v double", []), "d", "v", by=["day"])
    with pytest.raises(KeyError):
        trend.daily_series(table("d date, v double", []), "d", "v", by=["k"])


def test_no_window_holds_more_than_one_series(spark):
    """Series are dealt out by key once; no exchange brings all rows together."""
    df = spark.range(1000).selectExpr("id % 300 AS k", "date_add(DATE'2024-01-01', CAST(id % 20 AS INT)) AS d", "CAST(id AS DOUBLE) AS v")
    found = analyze_trend(df, "d", "v", by=["k"])
    for part in ("summary", "forecast"):
        plan = found[part]._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and plan.count("Exchange hashpartitioning") == 2
