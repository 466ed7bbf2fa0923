"""What must be true of the plans, whatever the data."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabscope.functions import kernels, late
from tabscope.operators import drift, filters, summary
from tabscope.operators.drift import pair_of


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "orders.parquet")
    spark.range(1000).selectExpr(
        "id", "id % 7 AS customer", "CAST(id AS DOUBLE) AS price", "CAST(id % 3 AS STRING) AS status",
        "CAST(timestamp_seconds(820454400 + id * 86400) AS TIMESTAMP_NTZ) AS day", "'x' AS note",
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan(df, executed=False):
    if executed:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def pushed(text):
    return " ".join(re.findall(r"PushedFilters: \[(.*?), ReadSchema", text))


def test_filters_reach_the_scan(orders):
    found = filters.filter_rows(orders, {"price": {"op": "gt", "value": 10.0}, "day": {"op": "lte", "value": "1997-01-01"}})
    assert "GreaterThan(price,10.0)" in pushed(plan(found)) and "LessThanOrEqual(day" in pushed(plan(found))


def test_split_reaches_the_scan_and_reads_three_columns(orders):
    pair = drift.split_by_range(orders, "day", ("1996-01-01", "1996-12-31"), ("1997-01-01", "1997-12-31"))
    text = plan(drift.explain_driver(pair, "price", "status"))
    assert "GreaterThanOrEqual(day" in pushed(text)
    assert "ReadSchema: struct<price:double,status:string,day:timestamp_ntz>" in text


def test_only_needed_columns_are_read(orders):
    assert "ReadSchema: struct<status:string>" in plan(summary.value_counts(orders, "status", None))


def test_driver_aggregates_before_the_shuffle_and_reuses_it(orders):
    pair = drift.split_by_column(orders, "status", "0", "1")
    text = plan(drift.explain_driver(pair, "price", "customer"), executed=True)
    assert "partial_sum" in text and "ReusedExchange" in text and "Window" not in text


def test_category_ranks_are_limited_in_every_task(orders):
    pair = drift.split_by_column(orders, "status", "0", "1")
    groups = late.grouped(late.text_rows(pair.rows, {"note": F.col("note")}, drift.SIDE), F.count_if(F.col(drift.SIDE) == "before").alias("n_before"), F.count_if(F.col(drift.SIDE) == "after").alias("n_after"))
    text = plan(drift.best_groups(groups.withColumn("shift_pts", F.lit(1.0)), 3))
    assert text.count("WindowGroupLimit") >= 6
    assert "WindowGroupLimit" in plan(drift.compare_categories(pair))


def test_two_snapshots_meet_without_a_join(orders):
    pair = pair_of(orders, orders)
    # The figures are found by one pass over both snapshots, before the table of them is made.
    text = plan(kernels.partial_moments(pair.rows, {"price": pair.number("price")}, F.when(F.col(drift.SIDE) == "before", 0).otherwise(1)))
    assert "Union" in text and "Join" not in text and "Exchange" not in text
    assert "Join" not in plan(drift.compare_metrics(pair))


def test_top_values_are_no_full_sort(orders):
    assert "TakeOrderedAndProject" in plan(summary.value_counts(orders, "customer"))


LATE = {
    "top values": lambda df: summary.top_values(df, ["t", "s"]),
    "frequent texts": lambda df: summary.value_counts(df, "t", 3),
    "shifts": lambda df: drift.compare_categories(drift.split_by_column(df, "side", "a", "b"), ["t", "s"], 2),
}


@pytest.mark.parametrize("name", LATE)
def test_long_texts_are_not_shuffled(spark, table, name):
    """Texts that begin alike, tie, or repeat: the answers are those of plain groups, whatever the length that is kept."""
    rng = random.Random(4)
    texts = [("x" * 40 + c) * n for c in "cab" for n in (1, 2)] + ["short", "", "y" * 31, "y" * 32, "y" * 33, None]
    rows = [(rng.choice(texts), rng.choice(["p", "q", None]), rng.choice("ab")) for _ in range(400)]
    df = table("t string, s string, side string", rows).repartition(5)
    found = sorted(map(tuple, LATE[name](df).collect()), key=repr)
    plain = late.BEGINNING
    try:
        late.BEGINNING = 10_000
        assert found == sorted(map(tuple, LATE[name](df).collect()), key=repr)
    finally:
        late.BEGINNING = plain
    if name == "frequent texts":
        counts = Counter(t for t, _, _ in rows if t is not None)
        assert found == sorted(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:3], key=repr)


def test_what_is_shuffled_does_not_grow_with_the_text(spark):
    rows = spark.range(200).select(F.repeat(F.sha2(F.col("id").cast("string"), 256), 100).alias("t"))
    groups = late.grouped(late.text_rows(rows, {"t": F.col("t")}), F.count("*").alias("n"))
    text = plan(groups)
    exchange = text.index("Exchange")
    sent = re.search(r"HashAggregate\(keys=\[(.*?)\], functions=\[(.*?)\]", text[exchange:])
    assert "value" not in sent.group(1) + sent.group(2) and groups.count() == 200
