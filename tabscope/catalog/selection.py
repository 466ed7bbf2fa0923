"""Queries on sources, exports, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope import columns
from tabscope.catalog import EVENTS_GAPS, ORDERS_GAPS, Derived, query
from tabscope.columns import small_table
from tabscope.operators import drift, filters
from tabscope.operators.pii import drop_pii_columns
from tabscope.sources import capped_export, preview, sample_rows, schema_summary
from tabscope.sources.readers import infer_types

AS_TEXT = Derived(
    "orders",
    (
        "CAST(o_orderkey AS STRING) AS o_orderkey",
        "CAST(o_totalprice AS STRING) AS o_totalprice",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS is_even",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS o_custkey",
        "CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate",
        "o_orderstatus",
    ),
)

CONTACTS = Derived(
    "customer",
    (
        "c_custkey",
        "c_mktsegment",
        "concat(lower(c_mktsegment), '.', CAST(c_custkey AS STRING), '@mail.example.com') AS contact",
        "concat('555-', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-0199') AS phone",
    ),
)


@query(
    "a2_csv_type_inference",
    "SELECT o_orderkey, o_totalprice, o_orderkey % 2 = 0 AS is_even,"
    " CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey,"
    " CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderstatus FROM orders",
)
def csv_type_inference(t):
    return infer_types(t.derived(AS_TEXT))


@query("a4_parquet_scan", "SELECT * FROM supplier")
def parquet_scan(t):
    return t.supplier


@query(
    "a6_capped_export",
    "SELECT *, (SELECT count(*) FROM lineitem) > 20000 AS truncated FROM lineitem"
    " ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20000",
)
def capped(t):
    return capped_export(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("a8_sample_rows")
def sample(t):
    return sample_rows(t.orders, ["o_orderkey"])


@query(
    "a8_sample_facts",
    "SELECT least(n, 5000) AS rows, least(n, 5000) AS keys, least(n, 5000) AS found FROM (SELECT count(*) AS n FROM orders)",
)
def sample_facts(t):
    """Size of the sample, its distinct keys, and how many of them the table has."""
    rows = sample_rows(t.orders, ["o_orderkey"])
    known = rows.select("o_orderkey").join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi").agg(F.count("*").alias("found"))
    sizes = rows.agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("keys")).collect()[0]
    return known.select(*[F.lit(sizes[name]).cast("bigint").alias(name) for name in ("rows", "keys")], "found")


@query("b1_filter_eq_other_type", "SELECT * FROM orders WHERE false AND o_orderkey > 0")
def filter_other_type(t):
    """Text equals no number, and a number no text."""
    by_text = filters.filter_rows(t.orders, {"o_orderkey": {"op": "eq", "value": "1"}})
    return by_text.unionByName(filters.filter_rows(t.orders, {"o_orderstatus": {"op": "eq", "value": 5}}))


@query(
    "a11_schema_summary",
    "SELECT CAST(p AS INTEGER) AS position, c AS \"column\", d AS dtype, (SELECT count(*) FROM orders) AS n_rows,"
    " CAST(6 AS BIGINT) AS n_columns FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'),"
    " (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'),"
    " (5, 'o_orderpriority', 'string')) v(p, c, d)",
)
def schema(t):
    return schema_summary(t.orders)


@query("a12_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def first_rows(t):
    return preview(t.orders, ["o_orderkey"])


def _filter(name: str, column: str, op: str, value, sql: str):
    @query(name, f"SELECT * FROM orders WHERE {sql}")
    def _(t):
        return filters.filter_rows(t.orders, {column: {"op": op, "value": value}})


_filter("b1a_filter_eq", "o_orderstatus", "eq", "F", "o_orderstatus = 'F'")
_filter("b1b_filter_gt", "o_totalprice", "gt", 250000.0, "o_totalprice > 250000")
_filter("b1c_filter_lt", "o_totalprice", "lt", 50000.0, "o_totalprice < 50000")
_filter("b1d_filter_gte", "o_totalprice", "gte", 400000, "o_totalprice >= 400000")
_filter("b1e_filter_lte", "o_orderdate", "lte", "1996-06-30", "o_orderdate <= '1996-06-30'")
_filter("b1f_filter_contains", "o_orderpriority", "contains", "^[1-3].*(urg|med)", "regexp_matches(o_orderpriority, '(?i)^[1-3].*(urg|med)')")


@query(
    "b1_filter_combined",
    f"SELECT * FROM {ORDERS_GAPS.sql} WHERE o_orderstatus = 'O' AND price >= 100000 AND contains(lower(priority), 'high')",
)
def combined(t):
    return filters.filter_rows(
        t.derived(ORDERS_GAPS),
        {
            "o_orderstatus": {"op": "eq", "value": "O"},
            "price": {"op": "gte", "value": 100000},
            "priority": {"op": "contains", "value": "HIGH"},
        },
    )


@query(
    "b2_split_by_column",
    "SELECT *, CASE o_orderstatus WHEN 'F' THEN 'before' ELSE 'after' END AS side FROM orders"
    " WHERE o_orderstatus IN ('F', 'O')",
)
def by_column(t):
    return drift.split_by_column(t.orders, "o_orderstatus", "F", "O").rows.withColumnRenamed(drift.SIDE, "side")


@query(
    "b3_split_by_range",
    "SELECT *, 'before' AS side FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1997-06-30'"
    " UNION ALL SELECT *, 'after' AS side FROM orders WHERE o_orderdate BETWEEN '1997-01-01' AND '1998-06-30'",
)
def by_range(t):
    pair = drift.split_by_range(t.orders, "o_orderdate", ("1996-01-01", "1997-06-30"), ("1997-01-01", "1998-06-30"))
    return pair.rows.withColumnRenamed(drift.SIDE, "side")


@query("b4_projection", "SELECT l_orderkey, l_quantity FROM lineitem")
def projection(t):
    return filters.project(t.lineitem, ["l_orderkey", "l_quantity"])


@query("b5_projection_by_type", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def by_type(t):
    return columns.select_by_class(t.orders, ["numeric", "datetime"])


@query("b6_drop_column", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def drop_one(t):
    return filters.drop_columns(t.customer, ["c_acctbal"])


@query("b7_drop_personal_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def drop_personal(t):
    return drop_pii_columns(t.derived(CONTACTS))


@query("b8_drop_missing_rows", f"SELECT * FROM {ORDERS_GAPS.sql} WHERE price IS NOT NULL")
def drop_missing(t):
    return filters.complete_rows(t.derived(ORDERS_GAPS), ["price"])


@query("b9_complete_rows", f"SELECT * FROM {ORDERS_GAPS.sql} WHERE price IS NOT NULL AND priority IS NOT NULL")
def complete(t):
    return filters.complete_rows(t.derived(ORDERS_GAPS), ["price", "priority"])


@query(
    "b10_picker_values",
    f"SELECT DISTINCT user_id FROM {EVENTS_GAPS.sql} WHERE user_id IS NOT NULL ORDER BY CAST(user_id AS VARCHAR) LIMIT 200",
)
def picker(t):
    return filters.picker_values(t.derived(EVENTS_GAPS), "user_id")


@query("h4_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("h5_same_table", "SELECT true AS same_as_itself, false AS same_when_changed")
def same(t):
    orders = t.orders
    shuffled = orders.orderBy(F.desc("o_orderkey"))
    changed = orders.withColumn("o_totalprice", F.col("o_totalprice") + 1)
    answers = (filters.same_table(orders, shuffled), filters.same_table(orders, changed))
    return small_table(t.spark, [answers], "same_as_itself boolean, same_when_changed boolean")
