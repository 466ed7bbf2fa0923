import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.functions.quantiles import exact_quantiles, values_at
from tabscope.functions import kernels
from tabscope.operators import insights, summary
from tests.conftest import as_dicts, by

WELLS = [
    (12.5, 310, "north", "w-1"), (14.0, 290, "south", "w-2"), (None, 305, "south", "w-3"), (13.2, 322, "north", "w-4"),
    (15.1, 298, "east", "w-5"), (12.9, 301, "north", "w-6"), (14.4, 315, "east", "w-7"), (13.7, 287, "south", "w-8"), (96.0, 640, "north", "w-9"),
]


@pytest.fixture(scope="module")
def wells(table):
    return table("depth double, flow bigint, crew string, tag string", WELLS)


@pytest.fixture(scope="module")
def nested(table):
    return table("key int, spot struct<x:int>, reading double", [(7, (3,), 0.5), (8, (4,), 1.5), (8, (4,), 1.5), (8, (4,), 1.5)])


# ── quantiles ────────────────────────────────────────────────────────────────


@pytest.mark.parametrize(
    "values",
    [
        [random.Random(3).gauss(0, 1) for _ in range(3000)],
        [float(i % 2) for i in range(2000)],
        [5.0] * 1500 + [float(i) for i in range(500)],
        [1e300, -1e300, *[0.001 * i for i in range(1000)]],
        [*[float("inf")] * 3, float("-inf"), *[float(i) for i in range(1600)]],
    ],
    ids=["normal", "two values", "one hot value", "far outliers", "infinite"],
)
def test_narrowing_is_exact(table, values):
    df = table("x double", [(v,) for v in values] + [(None,)] * 10)
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    # pandas has no answer between two infinite neighbours; the common value is one.
    expected = [pd.Series(values).quantile(p) for p in points[1:-1]]
    expected = [float("inf") if pd.isna(x) else x for x in expected]
    found = exact_quantiles(df, ["x"], points, buffer_rows=20)["x"]
    assert found[1:-1] == pytest.approx(expected, rel=1e-9, abs=1e-12)
    assert found[0] == min(values) and found[-1] == max(values)
    plain = exact_quantiles(df, ["x"], points)["x"]
    assert found[1:-1] == pytest.approx(plain[1:-1], rel=1e-9, abs=1e-12)


def test_rank_selection(table):
    rng = random.Random(5)
    values = sorted(rng.choice([rng.random(), 0.5]) for _ in range(1000))
    df = table("x double", [(v,) for v in values])
    ranks = [0, 1, 249, 500, 998, 999]
    found = values_at(df, [(F.col("x"), r, len(values)) for r in ranks], buffer_rows=10)
    assert found == [values[r] for r in ranks]


def test_buffers_of_many_columns_are_bounded_together(spark):
    df = spark.range(101).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(6)])
    found = exact_quantiles(df, df.columns, [0.25, 0.5], buffer_rows=250)
    assert found == {f"c{i}": [25.0 * (i + 1), 50.0 * (i + 1)] for i in range(6)}


def test_quantiles_of_nothing(table):
    assert exact_quantiles(table("x double", [(None,)]), ["x"], [0.5]) == {"x": [None]}
    assert exact_quantiles(table("x double", []), [], [0.5]) == {}


# ── insights ─────────────────────────────────────────────────────────────────


def test_insights_of_wells(wells):
    rows = as_dicts(insights.generate_insights(wells))
    kinds = lambda kind: [r for r in rows if r["kind"] == kind]
    shape = {r["column"]: r["count"] for r in kinds("shape")}
    assert shape == {"rows": 9, "columns": 4, "numeric": 2, "categorical": 2, "datetime": 0, "boolean": 0}
    assert [(r["column"], r["value"]) for r in kinds("missing")] == [("depth", 11.11)]
    assert [r["column"] for r in kinds("outliers")] == ["depth", "flow"]
    assert [r["column"] for r in kinds("high_cardinality")] == ["tag"]
    assert kinds("duplicates")[0]["count"] == 0
    top = kinds("correlation")[0]
    assert (top["column"], top["column2"]) == ("flow", "depth") and 0.9 < top["value"] <= 1


def test_outlier_share_is_of_present_values(wells):
    assert as_dicts(insights.outlier_columns(wells))[0] == {"column": "depth", "count": 1, "pct": 12.5}


def test_nested_columns(nested):
    assert [r[0] for r in insights.high_cardinality_columns(nested).collect()] == ["spot"]
    assert insights.duplicate_rows(nested).first()[0] == 2
    distinct = by(insights.distinct_counts(nested), "column")
    assert (distinct["key"]["n_distinct"], distinct["spot"]["n_distinct"]) == (2, None)
    assert insights.generate_insights(nested).count() > 0


def test_duplicates_tell_missing_places_apart(table):
    rows = [(None, "a"), ("a", None), (None, "a"), (None, None), (None, None), ("", None)]
    assert insights.duplicate_rows(table("x string, y string", rows)).first()[0] == 2


def test_sketches_never_decide_alone(spark):
    df = spark.range(2000).select(
        F.col("id").cast("string").alias("unique"),
        (F.col("id") % 1790).cast("string").alias("below"),
        (F.col("id") % 1810).cast("string").alias("above"),
        F.lit("x").alias("constant"),
    )
    assert [r[0] for r in insights.high_cardinality_columns(df).collect()] == ["unique", "above"]


def test_correlations_match_pandas_pairwise(table):
    rng = random.Random(2)
    rows = [tuple(None if rng.random() < 0.2 else rng.gauss(0, 1) + i * 0.01 for _ in range(4)) + (1.0, float(i)) for i in range(200)]
    names = ["a", "b", "c", "d", "flat", "full"]
    df = table(", ".join(f"{n} double" for n in names), rows)
    expected = pd.DataFrame(rows, columns=names).astype(float).corr().round(4)
    for r in as_dicts(insights.correlation_matrix(df)):
        wanted = expected.loc[r["column"], r["column2"]]
        assert r["correlation"] == (None if pd.isna(wanted) else pytest.approx(wanted, abs=1e-4))
    with pytest.raises(TypeError):
        insights.correlation_matrix(table("a int, t string", [(1, "x")]), ["a", "t"])


def test_a_constant_has_no_correlation(spark):
    df = spark.range(1000).select(F.lit(0.1).alias("a"), F.col("id").cast("double").alias("b"), (F.col("id") % 7).alias("c"))
    found = {(r["column"], r["column2"]): r["correlation"] for r in as_dicts(insights.correlation_matrix(df))}
    assert all((v is None) == ("a" in k) for k, v in found.items())
    assert [(r["column"], r["column2"]) for r in as_dicts(insights.strongest_correlations(df))] == [("c", "b")]


def test_wide_correlations_with_gaps_take_two_scans(spark, tmp_path):
    """A hundred columns: one scan for the means, one for all products; no expression per pair."""
    value = lambda i: (F.col("id") * (i + 3)) % (i + 7)
    columns = [F.when(F.col("id") % (i + 2) != 0, value(i)).cast("double").alias(f"c{i}") for i in range(100)]
    spark.range(300).select(*columns).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    pairs = insights.correlation_pairs(df)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1
    expected = df.toPandas().corr()
    rows = pairs.collect()
    assert len(rows) == 4950
    for r in rows[::37]:
        wanted = expected.loc[r["column"], r["column2"]]
        assert r["correlation"] == (None if pd.isna(wanted) else pytest.approx(wanted, abs=1e-9))


def test_repeats_shuffle_hashes_not_rows(spark, tmp_path):
    """Every row repeats and rows are long: 16 bytes of each different row and a count are shuffled."""
    spark.range(0, 4000, 1, 4).select((F.col("id") % 1000).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("t")).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    df = df.unionByName(df)
    found = insights.duplicate_rows(df)
    assert found.first()[0] == 4000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(h" in plan


def test_identifiers_are_counted_without_expand(spark):
    df = spark.range(500).select(*[F.concat(F.lit(str(i)), F.col("id")).alias(f"t{i}") for i in range(5)], F.lit("x").alias("same"))
    plan = insights.distinct_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert [r[0] for r in insights.high_cardinality_columns(df).collect()] == [f"t{i}" for i in range(5)]


def test_empty_and_all_missing_tables(table):
    empty = table("a double, b double, s string", [])
    assert insights.generate_insights(empty).filter("kind = 'missing'").count() == 0
    blank = table("a double, b double", [(None, None), (float("nan"), None)])
    assert [(r["column"], r["pct"]) for r in as_dicts(insights.missing_share(blank))] == [("a", 100.0), ("b", 100.0)]
    assert insights.outlier_columns(blank).count() == 0
    assert insights.duplicate_rows(blank).first()[0] == 1


# ── summary, profile ─────────────────────────────────────────────────────────


def stat(rows, column, statistic, field="number"):
    return next(r[field] for r in rows if r["column"] == column and r["statistic"] == statistic)


def test_summary_matches_pandas(table):
    rows = [(1, 2.5, "x", True), (2, None, "y", False), (3, 4.5, "y", True), (4, 10.0, None, None)]
    found = as_dicts(summary.get_summary(table("i int, d double, s string, b boolean", rows)))
    described = pd.DataFrame({"d": [2.5, None, 4.5, 10.0]}).describe()["d"]
    for name in ("count", "mean", "std", "min", "25%", "50%", "75%", "max"):
        assert stat(found, "d", name) == pytest.approx(described[name])
    assert stat(found, "d", "nulls") == 1
    assert (stat(found, "s", "unique"), stat(found, "s", "top", "text"), stat(found, "s", "freq")) == (2, "y", 2)
    assert stat(found, "b", "top", "text") == "true"


def test_summary_of_dates(table):
    rows = [(datetime.datetime(2024, 1, d),) for d in (1, 2, 3)]
    found = as_dicts(summary.get_summary(table("t timestamp", rows)))
    assert stat(found, "t", "mean", "text").startswith("2024-01-02T00:00:00")
    assert stat(found, "t", "25%", "text").startswith("2024-01-01T12:00:00")


TRIPS = [
    (4.0, "A", False, datetime.datetime(2023, 5, 3)), (11.0, "B", True, datetime.datetime(2023, 5, 9)), (7.5, "A", False, None),
    (None, "C", True, datetime.datetime(2023, 6, 2)), (4.0, "A", True, datetime.datetime(2023, 7, 11)),
    (19.5, "B", False, datetime.datetime(2023, 8, 30)), (8.0, "A", True, datetime.datetime(2023, 5, 3)), (9.0, "C", True, datetime.datetime(2023, 9, 1)),
]


def test_profiles(table):
    df = table("km double, line string, express boolean, left timestamp", TRIPS)
    km = {r["statistic"]: r["number"] for r in as_dicts(summary.profile_column(df, "km"))}
    assert (km["count"], km["missing"], km["missing_pct"]) == (8, 1, 12.5)
    assert (km["mean"], km["min"], km["max"], km["median"]) == (9, 4, 19.5, 8)
    line = as_dicts(summary.profile_column(df, "line"))
    assert [(r["value"], r["number"]) for r in line if r["statistic"] == "frequency"][0] == ("A", 4)
    express = {r["value"]: r["number"] for r in as_dicts(summary.profile_column(df, "express")) if r["statistic"] == "frequency"}
    assert express == {"true": 5, "false": 3}
    left = {r["statistic"]: r["value"] for r in as_dicts(summary.profile_column(df, "left"))}
    assert left["min"] == "2023-05-03T00:00:00" and left["max"] == "2023-09-01T00:00:00"


def test_profile_of_single_and_missing_values(table):
    one = {r["statistic"]: r["number"] for r in as_dicts(summary.profile_column(table("x int", [(4,)]), "x"))}
    assert one["std"] == 0.0 and one["mean"] == 4
    none = {r["statistic"] for r in as_dicts(summary.profile_column(table("x int", [(None,)]), "x"))}
    assert none == {"count", "missing", "missing_pct"}


def test_profile_of_nested_values(nested):
    rows = as_dicts(summary.profile_column(nested, "spot"))
    assert next(r["number"] for r in rows if r["statistic"] == "unique") is None
    assert [(r["value"], r["number"]) for r in rows if r["statistic"] == "frequency"][0] == ('{"x":4}', 3)
    assert summary.profile_bars(nested, "spot") is None


# ── chart data ───────────────────────────────────────────────────────────────


def test_histogram_keeps_empty_bins_and_the_right_edge(table):
    rows = summary.histogram(table("x double", [(0.0,), (0.4,), (10.0,), (None,)]), "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 0, 0, 0, 1]
    assert (rows[0]["left_edge"], rows[-1]["right_edge"]) == (0.0, 10.0)
    same = summary.histogram(table("x int", [(3,), (3,)]), "x", 4).orderBy("bin").collect()
    assert (same[0]["left_edge"], same[-1]["right_edge"]) == (2.5, 3.5) and sum(r["count"] for r in same) == 2
    assert summary.histogram(table("x int", [(None,)]), "x").count() == 0


@pytest.mark.parametrize("distinct, bins", [(2, 5), (12, 12), (80, 30), (400, 30)])
def test_profile_bins(spark, distinct, bins):
    assert summary.profile_histogram(spark.range(1000).select((F.col("id") % distinct).alias("x")), "x").count() == bins


def test_scatter_folds_rare_categories(spark):
    df = spark.range(100).select("id", F.sqrt("id").alias("y"), F.least(F.col("id") % 20, F.lit(10)).alias("hue"))
    hues = {r["hue"]: r["count"] for r in summary.scatter_points(df, "id", "y", "hue").groupBy("hue").count().collect()}
    assert len(hues) == 9 and hues["10"] == 50 and hues["Other"] == 15
    assert summary.scatter_points(df, "id", "y").columns == ["x", "y"]
    assert summary.profile_bars(df.filter("id < 0"), "hue") is None


def test_many_columns_are_one_pass(spark):
    """Four hundred columns with gaps: the figures of pandas, without an aggregate per column."""
    columns = [F.when(F.col("id") % (i % 7 + 2) != 0, (F.col("id") * (i + 3)) % (i % 50 + 5) - 1000.0 * i).alias(f"c{i}") for i in range(400)]
    df = spark.range(0, 1000, 1, 6).select(*columns, F.lit(" x").alias("s"), (F.col("id") % 2 == 0).alias("b"), F.lit(None).cast("date").alias("none"))
    local = df.toPandas()
    facts = insights.gather_facts(df)
    assert facts.rows == 1000 and facts.spaced == {"s": 1000} and facts.present["none"] == 0
    assert facts.constant.keys() == {c for c in df.columns if local[c].nunique() == 1} and facts.constant["s"] == " x"
    assert facts.present == {c: int(local[c].notna().sum()) for c in df.columns}
    assert all(facts.mean[c] == pytest.approx(local[c].mean(), rel=1e-12) for c in facts.mean)
    found = kernels.moments(df, {f"c{i}": F.col(f"c{i}") for i in range(400)}, F.when(F.col("b"), 0).otherwise(1))
    for side, rows in ((0, local[local["b"]]), (1, local[~local["b"]])):
        for i in range(0, 400, 7):
            m, own = found[side, f"c{i}"], rows[f"c{i}"]
            assert (m.rows, m.n) == (500, int(own.notna().sum()))
            if m.n:
                assert (m.low, m.high) == (own.min(), own.max()) and m.total == pytest.approx(own.sum(), rel=1e-12)
                assert m.std == pytest.approx(own.std(), rel=1e-9, abs=1e-12)


def test_figures_of_odd_columns(spark, table):
    df = table("a double, b double, c double", [(1.0, None, float("inf")), (float("nan"), None, 1.0), (-0.0, None, 2.0)])
    found = kernels.moments(df, {c: F.col(c) for c in "abc"})
    assert (found[0, "a"].n, found[0, "a"].low, found[0, "a"].high) == (2, 0.0, 1.0)
    assert (found[0, "b"].n, found[0, "b"].mean, found[0, "b"].low) == (0, None, None)
    assert found[0, "c"].total == float("inf")
    assert kernels.moments(df.limit(0), {"a": F.col("a")}) == {} and kernels.moments(df, {}) == {}
    assert insights.gather_facts(df.limit(0)).rows == 0
