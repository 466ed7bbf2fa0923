"""Queries on clusters, projections and feature importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import query, rounded
from tabscope.columns import small_table
from tabscope.operators import importance, segments

BUYER_COLUMNS = ["orders", "spent", "balance"]


def _buyers(t):
    """Customers with their number of orders, spending and balance."""
    spending = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    return t.customer.join(spending, F.col("c_custkey") == F.col("o_custkey")).select(
        "c_custkey", F.col("orders").cast("double").alias("orders"), "spent", F.col("c_acctbal").alias("balance"), "c_mktsegment"
    )


@query("o1_segments")
def clusters(t):
    found = segments.find_segments(_buyers(t), BUYER_COLUMNS)
    return found.rows.select("c_custkey", *BUYER_COLUMNS, "cluster")


_N_BUYERS = "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"


@query("o1_segments_facts", f"SELECT n AS n_rows, n AS n_buyers, CAST(4 AS BIGINT) AS n_clusters FROM ({_N_BUYERS})")
def cluster_facts(t):
    """Every complete row is in one cluster, and there are as many clusters as asked for."""
    rows = segments.find_segments(_buyers(t), BUYER_COLUMNS).rows
    return rows.agg(F.count("cluster").alias("n_rows"), F.count_distinct("c_custkey").alias("n_buyers"), F.count_distinct("cluster").alias("n_clusters"))


@query("o2_cluster_sizes_found", f"SELECT n AS total, CAST(4 AS BIGINT) AS n_clusters FROM ({_N_BUYERS})")
def found_sizes(t):
    found = segments.find_segments(_buyers(t), BUYER_COLUMNS)
    first = segments.cluster_profiles(found.rows, list(found.columns)).filter("rank = 1")
    return first.agg(F.sum("size").alias("total"), F.count("*").alias("n_clusters"))


def _profile_sql(label: str) -> str:
    view = (
        f"(SELECT {label} AS cluster, CAST(n AS DOUBLE) AS orders, spent, c_acctbal AS balance FROM customer JOIN"
        " (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY 1) ON c_custkey = o_custkey)"
    )
    parts = " UNION ALL ".join(
        f"SELECT cluster, count(*) AS size, '{c}' AS \"column\", avg({c}) AS m,"
        f" (SELECT avg({c}) FROM {view}) AS om, (SELECT stddev_samp({c}) FROM {view}) AS os, (SELECT count(*) FROM {view}) AS n"
        f" FROM {view} GROUP BY 1"
        for c in BUYER_COLUMNS
    )
    return f"""SELECT cluster, size, {rounded('100.0 * size / n', 2)} AS pct_of_rows, CAST(rank AS INTEGER) AS rank, "column",
      {rounded('m', 4)} AS cluster_mean, {rounded('om', 4)} AS overall_mean, {rounded('z', 3)} AS z_diff FROM
      (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, "column") AS rank FROM
        (SELECT *, (m - om) / CASE WHEN os = 0 THEN 1 ELSE os END AS z FROM ({parts}))) WHERE rank <= 5"""


@query("o2_cluster_profiles", _profile_sql("c_mktsegment"))
def profiles(t):
    """Profiles for given labels: here the market segments."""
    return segments.cluster_profiles(_buyers(t), BUYER_COLUMNS, "c_mktsegment")


@query("o2_profiles_of_many_groups", _profile_sql("c_custkey // 3"))
def many_profiles(t):
    """Some hundreds of groups at the smallest scale, in proportion to the customers at any."""
    return segments.cluster_profiles(_buyers(t).withColumn("block", F.expr("c_custkey DIV 3")), BUYER_COLUMNS, "block")


@query("o2_cluster_profiles_found")
def found_profiles(t):
    found = segments.find_segments(_buyers(t), BUYER_COLUMNS)
    return segments.cluster_profiles(found.rows, list(found.columns))


@query("o3_projection")
def projection(t):
    points, _ = segments.pca_projection(segments.find_segments(_buyers(t), BUYER_COLUMNS))
    return points




@query("n3_importance_regression")
def importance_regression(t):
    """What predicts a customer's spending?"""
    return importance.predict_importance(_buyers(t), "spent", key=["c_custkey"]).table


@query("n3_importance_classification")
def importance_classification(t):
    """What predicts the quality label of a document?"""
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "source", "n_chars", "toxic", "quality")
    return importance.predict_importance(rows, "quality", key=["doc_id"]).table


def _importance_facts(table):
    return table.groupBy("target", "task", "score_name", "n_rows_used", "n_train", "n_test").agg(
        F.array_join(F.array_sort(F.collect_list("column")), ",").alias("features")
    )


@query(
    "n3_importance_facts",
    "SELECT 'spent' AS target, 'regression' AS task, 'r2' AS score_name, n AS n_rows_used, n - t AS n_train, t AS n_test,"
    f" 'balance,c_custkey,c_mktsegment,orders' AS features FROM (SELECT n, CAST(ceil(0.25 * n) AS BIGINT) AS t FROM ({_N_BUYERS}))"
    " UNION ALL SELECT 'quality', 'classification', 'accuracy', n, n - t, t, 'doc_id,lang,n_chars,source,toxic' FROM"
    " (SELECT n, CAST(ceil(0.25 * n) AS BIGINT) AS t FROM (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id)))",
)
def importance_facts(t):
    """Task, exact split and features of both importance queries."""
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "source", "n_chars", "toxic", "quality")
    found = importance.predict_importance(_buyers(t), "spent", key=["c_custkey"], trees=5).table
    return _importance_facts(found).unionByName(_importance_facts(importance.predict_importance(rows, "quality", key=["doc_id"], trees=5).table))


@query(
    "n1_task_detection",
    "SELECT 'quality' AS target, count(DISTINCT quality) <= 10 AS classification FROM labels UNION ALL"
    " SELECT 'o_totalprice', false FROM orders WHERE o_totalprice % 1 <> 0 HAVING count(*) > 0 UNION ALL"
    " SELECT 'o_orderkey', count(DISTINCT o_orderkey) <= 10 FROM orders UNION ALL SELECT 'o_orderstatus', true FROM orders HAVING count(*) > 0",
)
def tasks(t):
    found = [("quality", importance.is_classification_target(t.labels, "quality"))]
    found += [(c, importance.is_classification_target(t.orders, c)) for c in ("o_totalprice", "o_orderkey", "o_orderstatus")]
    return small_table(t.spark, found, "target string, classification boolean")


@query(
    "n2_rank_codes",
    "SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT c_name AS value FROM customer)",
)
def codes(t):
    return importance.rank_codes(t.customer.select(F.col("c_name").alias("value")))
