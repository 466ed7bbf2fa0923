import json

import pytest
from pyspark.sql import functions as F

from tabscope.columns import select_by_class
from tabscope.sources import capped_export, load, preview, sample_rows, schema_summary, write_csv, write_report
from tabscope.sources import writers


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_missing_marks(spark, tmp_path):
    path = write(
        tmp_path / "t.csv",
        'id,price,ok,day,name\n1,1.5,True,2024-01-05,"a, b"\n2,NA,False,2024-02-01,n/a\n3,,True,,"two\nlines"\n',
    )
    df = load(spark, path, multi_line=True)
    assert dict(df.dtypes) == {"id": "bigint", "price": "double", "ok": "boolean", "day": "string", "name": "string"}
    rows = df.orderBy("id").collect()
    assert [r["price"] for r in rows] == [1.5, None, None]
    assert [r["name"] for r in rows] == ["a, b", None, "two\nlines"]


def test_csv_with_schema_needs_no_type_pass(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a,b\n1,2\n")
    assert load(spark, path, "a string, b double").dtypes == [("a", "string"), ("b", "double")]


def test_json_lines_and_splittable_csv(spark, tmp_path):
    lines = write(tmp_path / "lines.json", '{"a": 1}\n{"a": 2}\n')
    assert load(spark, lines, multi_line=False).count() == 2
    assert load(spark, write(tmp_path / "s.csv", "a\n1\n2\n"), multi_line=False).dtypes == [("a", "bigint")]


def test_json_keeps_nested_cells(spark, tmp_path):
    path = write(tmp_path / "t.json", json.dumps([{"id": 1, "meta": {"a": 1}}, {"id": 2, "meta": {"a": 2}}]))
    df = load(spark, path)
    assert dict(df.dtypes)["meta"] == "struct<a:bigint>" and df.count() == 2


def test_parquet_and_extension_case(spark, tmp_path):
    path = str(tmp_path / "t.PARQUET")
    spark.range(5).write.parquet(path)
    assert load(spark, path).count() == 5


@pytest.mark.parametrize("name", ["data.txt", "data.xlsx", "noextension"])
def test_unsupported_file_type(spark, name):
    with pytest.raises(ValueError, match="no reader"):
        load(spark, name)


def test_csv_round_trip(spark, table, tmp_path):
    df = table("id bigint, text string, x double", [(1, 'say "hi"', 1.5), (2, "a,b", None), (3, "line\nbreak", -2.25)])
    path = str(tmp_path / "out.csv")
    write_csv(df, path)
    assert sorted(load(spark, path, multi_line=True).collect()) == sorted(df.collect())


def test_report_sink(spark, table, tmp_path):
    write_report({"metrics": table("a int", [(1,), (2,)])}, str(tmp_path))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2


def test_capped_export(spark):
    big = capped_export(spark.range(25_000), ["id"])
    assert big.count() == 20_000 and big.filter("truncated").count() == 20_000
    assert big.agg(F.max("id")).first()[0] == 19_999
    small = capped_export(spark.range(100), ["id"])
    assert small.count() == 100 and small.filter("truncated").count() == 0


def test_capped_export_of_a_large_table_cuts_before_the_top_n(spark, monkeypatch):
    monkeypatch.setattr(writers, "BUFFER_ROWS", 1000)
    rows = spark.range(5000).select((F.col("id") * 7 % 5000).alias("id"))
    assert [r["id"] for r in capped_export(rows, ["id"], 50).orderBy("id").collect()] == list(range(50))


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(30_000)
    first, again = sample_rows(df, ["id"], 500), sample_rows(df.repartition(7), ["id"], 500)
    ids = sorted(r[0] for r in first.collect())
    assert len(set(ids)) == 500 and ids == sorted(r[0] for r in again.collect())
    other = sorted(r[0] for r in sample_rows(df, ["id"], 500, seed=7).collect())
    assert other != ids
    # Spread over the table, not taken from its start.
    assert 10_000 < sum(ids) / 500 < 20_000
    assert sample_rows(spark.range(10), ["id"], 500).count() == 10


def test_schema_summary_and_preview(spark):
    df = spark.range(60).withColumn("name", F.lit("x"))
    rows = schema_summary(df).orderBy("position").collect()
    assert [(r["column"], r["dtype"], r["n_rows"], r["n_columns"]) for r in rows] == [
        ("id", "bigint", 60, 2),
        ("name", "string", 60, 2),
    ]
    assert [r["id"] for r in preview(df, ["id"]).collect()] == list(range(50))


def test_type_classes(table):
    df = table("a int, b double, c string, d boolean, e timestamp, f date, g struct<x:int>", [])
    assert select_by_class(df, ["numeric"]).columns == ["a", "b"]
    assert select_by_class(df, ["categorical"]).columns == ["c", "g"]
    assert select_by_class(df, ["datetime", "boolean"]).columns == ["d", "e", "f"]


def test_csv_with_and_without_a_schema_is_the_same(spark, tmp_path):
    path = write(tmp_path / "s.csv", "id,price,name\n1,1.5,x\n2,NA,None\n3,,n/a\n")
    found = load(spark, path)
    given = load(spark, path, schema="id bigint, price double, name string")
    assert sorted(found.collect()) == sorted(given.collect()) and found.dtypes == given.dtypes


def test_large_csv_is_split_among_tasks(spark, tmp_path):
    path = write(tmp_path / "large.csv", "id,name\n" + "".join(f"{i},row {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert load(spark, path, schema="id bigint, name string").rdd.getNumPartitions() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("extension", ["jsonl", "ndjson"])
def test_json_by_line_is_split_among_tasks(spark, tmp_path, extension):
    path = tmp_path / f"rows.{extension}"
    path.write_text("".join(f'{{"a": {i}, "b": "x{i}"}}\n' for i in range(50)))
    df = load(spark, str(path))
    assert df.count() == 50 and "multiLine" not in df._jdf.queryExecution().toString().replace("multiLine -> false", "").replace("multiLine=false", "")
