import math
import random

import pytest
from pyspark.sql import functions as F

from tabscope.operators import importance, segments
from tabscope.session import FULLEST, SPREAD, parts_for
from tabscope.sources import load_model, save_model
from tests.conftest import as_dicts


@pytest.fixture(scope="module")
def groups(table):
    rng = random.Random(0)
    centres = [(20, 20), (60, 80), (100, 30)]
    rows = [(i, rng.gauss(x, 3), rng.gauss(y, 3)) for i in range(50) for x, y in centres]
    return table("id int, income double, spending double", rows)


def test_three_groups_are_found(groups):
    found = segments.find_segments(groups, ["income", "spending"], 3)
    assert found.applicable and found.n_clusters == 3 and found.n_rows == 150
    sizes = [r["count"] for r in found.rows.groupBy("cluster").count().collect()]
    assert sorted(sizes) == [50, 50, 50]
    profiles = as_dicts(segments.cluster_profiles(found.rows, list(found.columns)))
    assert sum(r["size"] for r in profiles if r["rank"] == 1) == 150
    assert {r["pct_of_rows"] for r in profiles} == {33.33}
    for r in profiles:
        assert abs(r["z_diff"]) <= max(abs(x["z_diff"]) for x in profiles if x["cluster"] == r["cluster"] and x["rank"] == 1)


def test_projection(groups):
    found = segments.find_segments(groups, ["income", "spending"], 3)
    points, variance = segments.pca_projection(found)
    assert points.count() == 150
    shares = [r["explained_variance"] for r in variance.orderBy("component").collect()]
    assert sum(shares) == pytest.approx(1.0, abs=1e-3) and shares[0] >= shares[1]
    # Standardised data: the two axes together carry all of the variance.
    row = points.agg(F.var_pop("pca_x") + F.var_pop("pca_y")).first()
    assert row[0] == pytest.approx(2.0, abs=1e-2)


def test_segments_do_not_apply(table, groups):
    assert not segments.find_segments(groups, ["income"]).applicable
    few = segments.find_segments(groups.limit(10), ["income", "spending"])
    assert not few.applicable and "20" in few.reason and few.summary(groups).first()["applicable"] is False
    text = groups.select(F.col("id").cast("string").alias("t"), "income")
    assert not segments.find_segments(text).applicable


def test_number_of_clusters_is_bounded(groups):
    assert segments.find_segments(groups, ["income", "spending"], 50, restarts=1).n_clusters == 8
    assert segments.find_segments(groups, ["income", "spending"], 1, restarts=1).n_clusters == 2


def test_rows_with_gaps_and_constant_columns(groups):
    gappy = groups.withColumn("income", F.when(F.col("id") >= 5, F.col("income"))).withColumn("flat", F.lit(1.0))
    found = segments.find_segments(gappy, ["income", "spending", "flat"], 3, restarts=2)
    assert found.n_rows == 135
    profiles = as_dicts(segments.cluster_profiles(found.rows, list(found.columns)))
    assert all(r["z_diff"] == 0 for r in profiles if r["column"] == "flat")


@pytest.fixture(scope="module")
def signal(table):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        strong, noise = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, strong if i % 20 else None, noise, rng.choice("abc"), int(strong > 0), 3 * strong + rng.gauss(0, 0.1)))
    return table("id int, strong double, noise double, category string, label int, amount double", rows)


def test_classification(signal, tmp_path):
    found = importance.predict_importance(signal.drop("amount", "id"), "label", trees=40)
    rows = as_dicts(found.table)
    assert rows[0]["column"] == "strong" and rows[0]["task"] == "classification" and rows[0]["score"] > 0.6
    assert (rows[0]["n_rows_used"], rows[0]["n_train"], rows[0]["n_test"]) == (200, 150, 50)
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0, abs=1e-3)


def test_a_saved_model_scores_raw_rows(spark, signal, tmp_path):
    for target, other in (("label", "amount"), ("amount", "label")):
        found = importance.predict_importance(signal.drop(other), target, key=["id"], trees=10)
        save_model(found.model, str(tmp_path / target))
        fresh = signal.withColumn("category", F.when(F.col("id") % 7 == 0, "unseen").otherwise(F.col("category"))).drop(other)
        scores = [sorted(m.score(fresh).select("id", "prediction").collect()) for m in (found.model, load_model(spark, str(tmp_path / target)))]
        assert scores[0] == scores[1] and len(scores[0]) == 200
    assert {r[1] for r in load_model(spark, str(tmp_path / "label")).score(signal).select("id", "prediction").collect()} == {"0", "1"}


def test_regression_with_reproducible_split(signal):
    first = importance.predict_importance(signal.drop("label"), "amount", key=["id"], trees=20)
    again = importance.predict_importance(signal.drop("label").repartition(5), "amount", key=["id"], trees=20)
    rows = as_dicts(first.table)
    assert rows[0]["column"] == "strong" and rows[0]["task"] == "regression" and rows[0]["score"] > 0.5
    assert (rows[0]["n_train"], rows[0]["n_test"]) == (as_dicts(again.table)[0]["n_train"], as_dicts(again.table)[0]["n_test"])


def test_forests_train_on_a_bounded_number_of_parts(signal, monkeypatch):
    """Each part sends the figures of all nodes of a level."""
    seen = []
    for forest in (importance.RandomForestRegressor, importance.RandomForestClassifier):
        fit = forest.fit
        monkeypatch.setattr(forest, "fit", lambda self, rows, fit=fit: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    monkeypatch.setattr(importance, "ROWS_PER_PART", 1)
    for target, other in (("amount", "label"), ("label", "amount")):
        found = as_dicts(importance.predict_importance(signal.drop(other), target, key=["id"], trees=5).table)[0]
        assert (found["n_train"], found["n_test"]) == (150, 50)
    assert seen == [SPREAD, SPREAD]


def test_clusters_are_fitted_on_a_bounded_number_of_parts(groups, monkeypatch):
    """Each part of each iteration of each start sends the driver a report."""
    seen, fit = [], segments.KMeans.fit
    monkeypatch.setattr(segments.KMeans, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    monkeypatch.setattr(segments, "ROWS_PER_TASK", 1)
    found = segments.find_segments(groups, ["income", "spending"], 3, restarts=2)
    assert seen == [SPREAD, SPREAD]
    assert sorted(r["count"] for r in found.rows.groupBy("cluster").count().collect()) == [50, 50, 50]


def test_rows_of_segments_are_worked_out_once(spark, groups):
    """Every pass over a joined table would join it, and send out its smaller side, again."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = segments.find_segments(groups.mapInArrow(counted, groups.schema), ["income", "spending"], 3, restarts=2)
    points, _ = segments.pca_projection(found)
    assert points.count() == 150 and segments.cluster_profiles(found.rows, list(found.columns)).count() == 6
    assert read.value == 150


def test_parts_follow_the_rows():
    assert [parts_for(n, -(-n // 2000)) for n in (1, 15_000, 64_000, 90_000, 5_400_000)] == [1, 8, 32, 32, 32]
    assert parts_for(100 * FULLEST, 50_000) == 100


def test_places_in_groups_are_exact_where_draws_tie(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 3 == 0).cast("double").alias("g"), (F.col("id") % 7).alias("draw"), F.xxhash64("id").alias("tie"))
    found = importance.ranked_within(rows.repartition(7), "g", ["draw", "tie"], "place")
    again = importance.ranked_within(rows.repartition(3), "g", ["draw", "tie"], "place")
    places = {r["id"]: r["place"] for r in found.collect()}
    assert places == {r["id"]: r["place"] for r in again.collect()}
    for g in (0.0, 1.0):
        own = [(r["draw"], r["tie"], r["id"]) for r in rows.where(F.col("g") == g).collect()]
        assert [places[i] for _, _, i in sorted(own)] == list(range(len(own)))


def test_the_split_is_exact_under_few_keys(signal):
    few = signal.withColumn("k", F.col("id") % 7).drop("amount", "id")
    for key in (["k"], ["category"]):
        assert as_dicts(importance.predict_importance(few, "label", key=key, trees=3).table)[0]["n_test"] == 50
    constant = few.withColumn("one", F.lit(1))
    assert as_dicts(importance.predict_importance(constant, "label", key=["one"], trees=3).table)[0]["n_test"] == 50


def test_rank_codes_are_places_in_text_order(spark):
    values = spark.range(500).select(F.concat(F.lit("v"), F.col("id") % 300).alias("value")).repartition(6)
    codes = {r["value"]: r["code"] for r in importance.rank_codes(values).collect()}
    assert codes == {v: float(i) for i, v in enumerate(sorted({f"v{i}" for i in range(300)}))}
    assert importance.rank_codes(values.filter("value is null")).count() == 0


@pytest.mark.parametrize(
    "rows, word",
    [([(i, 1) for i in range(10)], "20 rows"), ([(i, 1) for i in range(30)], "one distinct"), ([(i, i == 0) for i in range(30)], "two rows")],
)
def test_importance_does_not_apply(table, rows, word):
    kind = "boolean" if isinstance(rows[0][1], bool) else "int"
    found = as_dicts(importance.predict_importance(table(f"x int, y {kind}", rows), "y").table)
    assert len(found) == 1 and found[0]["applicable"] is False and word in found[0]["reason"]


def test_importance_needs_features_and_takes_many_classes(table):
    rows = [(i // 2, f"name{i // 2}") for i in range(300)]
    df = table("y int, name string", rows)
    assert "features" in as_dicts(importance.predict_importance(df.select("name"), "name").table)[0]["reason"]
    many = as_dicts(importance.predict_importance(df, "name", trees=3).table)[0]
    assert many["applicable"] and (many["task"], many["n_test"]) == ("classification", 75)


@pytest.mark.parametrize(
    "kind, values, expected",
    [("int", [0, 1, 1], True), ("double", [1.0, 2.0, None], True), ("double", [1.5, 2.0], False), ("int", list(range(50)), False), ("boolean", [True], True), ("string", ["a"], True)],
)
def test_task_detection(table, kind, values, expected):
    assert importance.is_classification_target(table(f"y {kind}", [(v,) for v in values]), "y") is expected


def test_test_sizes_keep_proportions(table):
    counts = table("label double, count bigint", [(0.0, 97), (1.0, 33), (2.0, 3)])
    sizes = {r["label"]: r["in_test"] for r in importance._test_sizes(counts, 133, math.ceil(0.25 * 133)).collect()}
    assert sum(sizes.values()) == 34 and sizes[0.0] in (24, 25) and sizes[1.0] in (8, 9) and sizes[2.0] in (0, 1)


def test_profiles_of_many_groups_meet_in_no_single_window(spark):
    rows = spark.range(3000).select((F.col("id") % 700).alias("g"), (F.col("id") * 7 % 13).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    found = segments.cluster_profiles(rows, ["a", "b"], "g")
    assert found.count() == 1400 and {r["overall_mean"] for r in found.where("column = 'b'").collect()} == {1499.5}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Subquery")[0]
    assert segments.cluster_profiles(rows.limit(0), ["a", "b"], "g").count() == 0
