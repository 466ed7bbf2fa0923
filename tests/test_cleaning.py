import datetime
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.functions.dates import parse_mixed
from tabscope.functions.text import strip, to_number
from tabscope.operators import cleaning
from tests.conftest import as_dicts, by

CODES = [11, 12, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21]
WEIGHTS = [4.5, 5.3, 5.3, None, 4.8, 5.2, 5.1, 4.9, 77.0, 4.7, 5.3, 5.0]
PORTS = ["Oslo", "Bari ", "Bari ", "Kiel", "Oslo", "Kiel", " Kiel", "Oslo", "Bari", "Oslo", "Kiel", "Bari"]


@pytest.fixture(scope="module")
def messy(table):
    return table("code int, weight double, port string", list(zip(CODES, WEIGHTS, PORTS)))


def column(table, values, kind="string"):
    return table(f"v {kind}", [(v,) for v in values])


def test_detectors(messy):
    issues = {(r["kind"], r["column"]): r for r in as_dicts(cleaning.detect_all_issues(messy))}
    assert set(issues) == {("duplicates", None), ("missing", "weight"), ("outliers", "weight"), ("whitespace", "port")}
    assert (issues["duplicates", None]["count"], issues["duplicates", None]["pct"]) == (1, 8.33)
    assert (issues["missing", "weight"]["count"], issues["missing", "weight"]["numeric"]) == (1, True)
    # The share of outliers is of all rows here, missing values included.
    assert issues["outliers", "weight"]["pct"] == 8.33
    assert issues["whitespace", "port"]["count"] == 3
    assert cleaning.count_open_issues(cleaning.detect_all_issues(messy)).first()[0] == 4


def test_fences_match_pandas(messy):
    found = as_dicts(cleaning.detect_outliers(messy))[0]
    q1, q3 = pd.Series(WEIGHTS).quantile([0.25, 0.75])
    assert found["lower"] == pytest.approx(q1 - 1.5 * (q3 - q1)) and found["upper"] == pytest.approx(q3 + 1.5 * (q3 - q1))


def test_clean_table_has_no_issues(table):
    df = table("a int, b string", [(1, "x"), (2, "y"), (3, "z")])
    assert cleaning.detect_all_issues(df).count() == 0


def test_at_most_eight_of_a_kind(table):
    df = table(", ".join(f"c{i} int" for i in range(12)), [tuple([None] * 12), tuple(range(12))])
    assert cleaning.detect_missing(df).count() == 8


@pytest.mark.parametrize(
    "values, kind",
    [
        (["7", "-3", "0.25", "19"], "type_numeric"),
        (["2021-06-30", "2021-07-31", "2021-08-31", "2021-09-30"], "type_datetime"),
        (["04109", "10115", "20095", "50667"], "type_numeric"),
        (["red", "teal", "ochre", "mauve"], None),
        (["20240105", "20240106", None], "type_datetime"),
        ([None, None], None),
        (["1"] * 95 + ["x"] * 5, "type_numeric"),
        (["1"] * 94 + ["x"] * 6, None),
    ],
)
def test_type_issues(table, values, kind):
    assert [r["kind"] for r in as_dicts(cleaning.detect_type_issues(column(table, values)))] == ([kind] if kind else [])


def test_constant_and_empty_columns(table):
    rows = [("kg", None, n, (5,)) for n in range(4)]
    found = by(cleaning.detect_constant_columns(table("unit string, remark string, no int, n struct<x:int>", rows)), "column")
    assert {c: r["kind"] for c, r in found.items()} == {"unit": "constant_column", "remark": "empty_column"}
    assert found["unit"]["value"] == "kg"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-05", "2024-01-05 00:00:00"), ("2024-01-05T10:30:00", "2024-01-05 10:30:00"), (" 2024-01-05 10:30 ", "2024-01-05 10:30:00"),
        ("2024-01-05T10:30:00Z", "2024-01-05 10:30:00"), ("01/02/2024", "2024-01-02 00:00:00"), ("13/02/2024", "2024-02-13 00:00:00"),
        ("2024/3/7", "2024-03-07 00:00:00"), ("20240105", "2024-01-05 00:00:00"), ("Jan 5 2024", "2024-01-05 00:00:00"),
        ("january 5, 2024", "2024-01-05 00:00:00"), ("5 January 2024", "2024-01-05 00:00:00"), ("5 Jan 2024", "2024-01-05 00:00:00"),
        ("2024", "2024-01-01 00:00:00"), ("12:30", None), ("abc", None), ("", None), ("555-123-4567", None), ("2024-13-45", None), ("99999999", None),
    ],
)
def test_mixed_dates(table, text, expected):
    found = column(table, [text]).select(F.date_format(parse_mixed(F.col("v")), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert found == expected


@pytest.mark.parametrize("text, expected", [("10", 10.0), (" 1.5 ", 1.5), ("-2e3", -2000.0), (".5", 0.5), ("5.", 5.0), ("1d", None), ("0x10", None), ("1,000", None), ("1_000", None), ("", None), ("nan", None), ("-Infinity", float("-inf"))])
def test_numbers(table, text, expected):
    assert column(table, [text]).select(to_number(F.col("v"))).first()[0] == expected


@pytest.mark.parametrize("text", ["  a b ", "\t\na ", " x　", "plain", "", "   ", "\x1cz\x1f", "a\n"])
def test_strip_is_like_python(table, text):
    assert column(table, [text]).select(strip(F.col("v"))).first()[0] == text.strip()


def test_fixes_leave_the_input_alone(messy):
    before = sorted(messy.collect(), key=str)
    fixed = cleaning.remove_duplicate_rows(messy)
    assert fixed.count() == 11 and sorted(messy.collect(), key=str) == before


@pytest.mark.parametrize("strategy, expected", [("median", 5.1), ("mean", pd.Series(WEIGHTS).mean()), ("mode", 5.3), ("zero", 0.0)])
def test_fill_missing(messy, strategy, expected):
    filled = cleaning.fill_missing(messy, "weight", strategy)
    assert filled.filter("weight is null").count() == 0
    assert filled.filter("code = 13").first()["weight"] == pytest.approx(expected)


def test_fill_edges(table):
    ties = column(table, ["b", "a", "b", "a", None])
    assert cleaning.fill_missing(ties, "v", "mode").filter("v = 'a'").count() == 3
    assert cleaning.fill_missing(column(table, [None, None]), "v", "mode").filter("v is null").count() == 2
    with pytest.raises(ValueError):
        cleaning.fill_missing(ties, "v", "magic")
    halves = cleaning.fill_missing(column(table, [1, 2, None], "int"), "v", "median")
    assert sorted(r[0] for r in halves.collect()) == [1.0, 1.5, 2.0]


def test_outlier_fixes(messy, table):
    capped = cleaning.cap_outliers(messy, "weight")
    assert capped.count() == 12 and capped.agg(F.max("weight")).first()[0] < 77 and capped.filter("weight is null").count() == 1
    kept = cleaning.remove_outlier_rows(messy, "weight")
    assert kept.count() == 11 and kept.filter("weight is null").count() == 1
    flat = column(table, [5.0, 5.0, 5.0, 5.0, 9.0], "double")
    assert cleaning.cap_outliers(flat, "v").collect() == flat.collect()


def test_text_fixes(messy, table):
    assert {r["port"] for r in cleaning.trim_whitespace(messy, "port").collect()} == {"Oslo", "Bari", "Kiel"}
    assert cleaning.trim_whitespace(messy, "weight").collect() == messy.collect()
    numbers = cleaning.convert_to_numeric(column(table, ["1", "x", None]), "v")
    assert [r[0] for r in numbers.collect()] == [1.0, None, None]
    dates = cleaning.convert_to_datetime(column(table, ["2024-01-05", "x"]), "v")
    assert [r[0] for r in dates.collect()] == [datetime.datetime(2024, 1, 5), None]


def test_fixes_in_sequence(messy):
    steps = [
        ("remove_duplicate_rows", {}),
        ("fill_missing", {"column": "weight", "strategy": "median"}),
        ("cap_outliers", {"column": "weight"}),
        ("trim_whitespace", {"column": "port"}),
    ]
    assert cleaning.detect_all_issues(cleaning.apply_fixes(messy, steps)).count() == 0


def test_duplicates_of_nested_rows(table):
    df = table("id int, m map<string,int>", [(1, {"a": 1}), (1, {"a": 1}), (2, {"a": 1})])
    assert cleaning.remove_duplicate_rows(df).count() == 2


def test_date_columns(table):
    df = table("a timestamp, b string, c string, d int", [(datetime.datetime(2024, 1, 1), "2024-01-01", "x", 1)])
    assert cleaning.date_columns(df) == ["a", "b"]


def test_missing_is_one_value_for_detecting_and_fixing(table):
    nan = float("nan")
    df = table("x double, y string", [(nan, "a"), (None, "a"), (1.0, "b")])
    assert as_dicts(cleaning.detect_duplicates(df))[0]["count"] == 1
    assert cleaning.detect_duplicates(cleaning.remove_duplicate_rows(df)).count() == 0


def test_fixes_of_whole_columns_change_nothing(table):
    big = 9007199254740993
    df = column(table, [big, 3, 4, 5], "bigint")
    for strategy in ("median", "mean", "mode", "zero"):
        assert cleaning.fill_missing(df, "v", strategy).collect() == df.collect()
    even = column(table, [1, 2, 3, 4, 5], "bigint")
    assert cleaning.cap_outliers(even, "v").schema == even.schema
    prices = table("v decimal(10,2)", [(Decimal("1.10"),), (Decimal("2.20"),), (None,)])
    assert sorted(r[0] for r in cleaning.fill_missing(prices, "v", "mean").collect()) == [Decimal("1.10"), Decimal("1.65"), Decimal("2.20")]


def test_first_row_of_each_key(spark, table):
    """Keys may be missing or nested; equal places are told apart by the row, not by where it lies."""
    rows = [(1, "a", 3.0, "x"), (1, "a", 1.0, "y"), (None, "a", 2.0, "z"), (None, "a", None, "w"), (float("nan"), "a", 5.0, "v"), (2, "b", 1.0, "q"), (2, "b", 1.0, "p"), (2, "b", 1.0, "p")]
    df = table("k double, s string, o double, v string", [(None if r[0] is None else float(r[0]), *r[1:]) for r in rows])
    found = {(r["k"], r["s"]): r["v"] for r in cleaning.keep_first(df, ["k", "s"], ["o"]).collect()}
    assert found.keys() == {(1.0, "a"), (None, "a"), (2.0, "b")}
    assert (found[1.0, "a"], found[None, "a"]) == ("y", "w") and found[2.0, "b"] in ("p", "q")
    again = {(r["k"], r["s"]): r["v"] for r in cleaning.keep_first(df.orderBy("v").repartition(3), ["k", "s"], ["o"]).collect()}
    assert again == found
    latest = {r["k"]: r["v"] for r in cleaning.keep_first(df, ["k"], [-F.col("o")]).where("k = 1").collect()}
    assert latest == {1.0: "x"}
    nested = df.select(F.struct("k", "s").alias("pair"), F.array("v").alias("list"), "o")
    kept = cleaning.keep_first(nested, ["pair"], ["o"])
    # Inside nested cells NaN is a value of its own.
    assert kept.columns == nested.columns and kept.dtypes == nested.dtypes and kept.count() == 4
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()
    assert cleaning.keep_first(df.limit(0), ["k"], ["o"]).count() == 0
    with pytest.raises(KeyError):
        cleaning.keep_first(df, ["nope"], ["o"])
    with pytest.raises(ValueError):
        cleaning.keep_first(df, ["k"], [])
