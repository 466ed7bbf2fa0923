"""Queries on differences between snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import LINES_BY_YEAR, ORDERS_BY_YEAR, ORDERS_GAPS, Derived, query, rounded, sided
from tabscope.columns import small_table
from tabscope.operators import drift, significance
from tabscope.plans import reports

LINES = sided("lineitem", *LINES_BY_YEAR)
ORDERS = sided("orders", *ORDERS_BY_YEAR)
_B, _A = "FILTER (WHERE side = 'before')", "FILTER (WHERE side = 'after')"


def lines(t):
    return drift.split_by_range(t.lineitem, *LINES_BY_YEAR)


def orders(t):
    return drift.split_by_range(t.orders, *ORDERS_BY_YEAR)


def _pct(before: str, after: str) -> str:
    change = rounded(f"100.0 * (({after}) - ({before})) / nullif({before}, 0)", 2)
    return f"CASE WHEN {before} = 0 THEN CASE WHEN {after} <> 0 THEN CAST('inf' AS DOUBLE) END ELSE {change} END"


# ── drivers ──────────────────────────────────────────────────────────────────


def segments_sql(rows: str, segment: str, metric: str, agg: str) -> str:
    return (
        f"(SELECT CAST({segment} AS VARCHAR) AS segment, coalesce({agg}({metric}) {_B}, 0) AS b,"
        f" coalesce({agg}({metric}) {_A}, 0) AS a FROM {rows} WHERE {segment} IS NOT NULL GROUP BY 1)"
    )


def _driver_sql(segments: str) -> str:
    return (
        f"SELECT segment, {rounded('b', 4)} AS before, {rounded('a', 4)} AS after, {rounded('a - b', 4)} AS delta,"
        f" {rounded('100.0 * (a - b) / nullif(sum(a) OVER () - sum(b) OVER (), 0)', 2)} AS contribution_pct FROM {segments}"
    )


def _totals_sql(segments: str) -> str:
    return (
        f"SELECT {rounded('tb', 4)} AS total_before, {rounded('ta', 4)} AS total_after, {rounded('ta - tb', 4)} AS total_delta,"
        f" {_pct('tb', 'ta')} AS total_pct_change, n AS n_segments, ta <> tb AND n > 1 AND"
        f" CASE WHEN ta > tb THEN up ELSE down END < n / 2.0 AS mix_shift FROM (SELECT sum(b) AS tb, sum(a) AS ta, count(*) AS n,"
        f" count(*) FILTER (WHERE round(a - b, 4) > 0) AS up, count(*) FILTER (WHERE round(a - b, 4) < 0) AS down FROM {segments})"
    )


_FLAG_SEGMENTS = segments_sql(LINES, "l_returnflag", "l_extendedprice", "sum")


@query("d16_driver_sum", _driver_sql(_FLAG_SEGMENTS))
def driver(t):
    """Revenue 1996 to 1997: which return flag drove it?"""
    return drift.explain_driver(lines(t), "l_extendedprice", "l_returnflag")


@query("d16_driver_mean", _driver_sql(segments_sql(LINES, "l_linenumber", "l_extendedprice", "avg")))
def driver_mean(t):
    return drift.explain_driver(lines(t), "l_extendedprice", "l_linenumber", "mean")


@query("d16_driver_many_segments", _driver_sql(segments_sql(LINES, "l_partkey", "l_extendedprice", "sum")))
def driver_many(t):
    return drift.explain_driver(lines(t), "l_extendedprice", "l_partkey")


@query("d17_driver_totals", _totals_sql(_FLAG_SEGMENTS))
def totals(t):
    return drift.driver_totals(lines(t), "l_extendedprice", "l_returnflag")


@query("d17_driver_totals_mean", _totals_sql(segments_sql(ORDERS, "o_orderpriority", "o_totalprice", "avg")))
def totals_mean(t):
    return drift.driver_totals(orders(t), "o_totalprice", "o_orderpriority", "mean")


# One segment outweighs the others, which all move against it.
TILTED = Derived(
    "orders",
    (
        "o_orderpriority",
        "o_orderdate",
        "CASE WHEN (o_orderpriority = '1-URGENT') = (o_orderdate < '1997-01-01') THEN o_totalprice * 9 ELSE o_totalprice END AS price",
    ),
)
_TILTED_ROWS = sided(TILTED.sql, *ORDERS_BY_YEAR)


@query("d18_mix_shift", _totals_sql(segments_sql(_TILTED_ROWS, "o_orderpriority", "price", "avg")))
def mix_shift(t):
    pair = drift.split_by_range(t.derived(TILTED), *ORDERS_BY_YEAR)
    return drift.driver_totals(pair, "price", "o_orderpriority", "mean")


@query(
    "c4_align_segments",
    "SELECT coalesce(x.k, y.k) AS segment, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after FROM"
    " (SELECT CAST(c_nationkey AS VARCHAR) AS k, CAST(count(*) AS DOUBLE) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) x"
    " FULL JOIN (SELECT CAST(s_nationkey AS VARCHAR) AS k, CAST(count(*) AS DOUBLE) AS n FROM supplier GROUP BY 1) y ON x.k = y.k",
)
def align(t):
    customers = t.customer.filter("c_acctbal > 0").groupBy("c_nationkey").count()
    return drift.align_segments(customers, t.supplier.groupBy("s_nationkey").count())


@query(
    "d19_pct_change",
    f"SELECT segment, {_pct('b', 'a')} AS pct_change FROM {segments_sql(LINES, 'l_linenumber', 'l_quantity', 'sum')}",
)
def change(t):
    rows = drift.segment_aggregates(lines(t), "l_quantity", "l_linenumber")
    return rows.select("segment", drift.pct_change(F.col("before"), F.col("after")).alias("pct_change"))


# ── schema, metrics, categories ──────────────────────────────────────────────


def _changed_schema(t):
    """Orders against orders with a column gone, one new and one of another type."""
    after = t.orders.selectExpr(
        "o_orderkey", "CAST(o_custkey AS STRING) AS o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_totalprice > 100000 AS large",
    ).filter("o_totalprice > 50000")
    return drift.pair_of(t.orders, after)


@query(
    "d13_compare_schemas",
    "SELECT * FROM (VALUES ('added_column', 'large', NULL, 'boolean', CAST(NULL AS DOUBLE)),"
    " ('removed_column', 'o_orderpriority', 'string', NULL, NULL), ('dtype_change', 'o_custkey', 'bigint', 'string', NULL),"
    " ('common_column', 'o_orderkey', 'bigint', 'bigint', NULL), ('common_column', 'o_custkey', 'bigint', 'string', NULL),"
    " ('common_column', 'o_orderstatus', 'string', 'string', NULL), ('common_column', 'o_totalprice', 'double', 'double', NULL),"
    " ('common_column', 'o_orderdate', 'timestamp_ntz', 'timestamp_ntz', NULL)) v(kind, \"column\", before, after, pct_change)"
    f" UNION ALL SELECT 'row_count', NULL, CAST(n AS VARCHAR), CAST(m AS VARCHAR), {rounded('100.0 * (m - n) / n', 2)} FROM"
    " (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice > 50000) AS m FROM orders)",
)
def schemas(t):
    return drift.compare_schemas(_changed_schema(t))


def _metric_sql(rows: str, c: str, value: str | None = None) -> str:
    v = value or c
    sb, sa = f"coalesce(sum({v}) {_B}, 0)", f"coalesce(sum({v}) {_A}, 0)"
    mb, ma = f"avg({v}) {_B}", f"avg({v}) {_A}"
    return (
        f"SELECT '{c}' AS \"column\", {rounded(sb, 4)} AS sum_before, {rounded(sa, 4)} AS sum_after, {_pct(sb, sa)} AS sum_pct_change,"
        f" {rounded(mb, 4)} AS mean_before, {rounded(ma, 4)} AS mean_after, {_pct(mb, ma)} AS mean_pct_change FROM {rows}"
    )


_LINE_METRICS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("d14_compare_metrics", " UNION ALL ".join(_metric_sql(LINES, c) for c in _LINE_METRICS))
def metrics(t):
    return drift.compare_metrics(lines(t))


_GAP_ROWS = sided(ORDERS_GAPS.sql, *ORDERS_BY_YEAR)


@query(
    "d14_compare_metrics_with_gaps",
    " UNION ALL ".join(
        [*[_metric_sql(_GAP_ROWS, c) for c in ("o_orderkey", "o_custkey", "price")], _metric_sql(_GAP_ROWS, "flagged", "CAST(flagged AS INTEGER)")]
    ),
)
def gappy_metrics(t):
    return drift.compare_metrics(drift.split_by_range(t.derived(ORDERS_GAPS), *ORDERS_BY_YEAR))


def _shares_sql(rows: str, columns: dict[str, str]) -> str:
    values = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {e} AS value, side FROM {rows} WHERE {c} IS NOT NULL" for c, e in columns.items()
    )
    share = "100.0 * n{s} / nullif(sum(n{s}) OVER (PARTITION BY \"column\"), 0)"
    return (
        f"(SELECT *, {rounded('sb', 2)} AS share_before, {rounded('sa', 2)} AS share_after, {rounded('sa - sb', 2)} AS shift_pts FROM"
        f" (SELECT *, coalesce({share.format(s='b')}, 0) AS sb, coalesce({share.format(s='a')}, 0) AS sa FROM"
        f" (SELECT \"column\", value, count(*) {_B} AS nb, count(*) {_A} AS na FROM ({values}) GROUP BY 1, 2)))"
    )


def _categories_sql(shares: str) -> str:
    part = (
        "SELECT \"column\", '{kind}' AS kind, CAST(r AS INTEGER) AS rank, value, share_before, share_after, shift_pts FROM"
        " (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY {order}) AS r FROM {shares} WHERE {test}) WHERE r <= 5"
    )
    kinds = {"shift": ("true", "abs(shift_pts) DESC, value"), "new": ("nb = 0", "value"), "dropped": ("na = 0", "value")}
    return " UNION ALL ".join(part.format(kind=k, test=w, order=o, shares=shares) for k, (w, o) in kinds.items())


_ORDER_SHARES = _shares_sql(
    ORDERS,
    {
        "o_orderstatus": "o_orderstatus",
        "o_orderpriority": "o_orderpriority",
        "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')",
    },
)


@query("d15_compare_categories", _categories_sql(_ORDER_SHARES))
def categories(t):
    return drift.compare_categories(orders(t))


@query(
    "c5_category_counts",
    f"SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) {_B} AS n_before, count(*) {_A} AS n_after"
    f" FROM {ORDERS} GROUP BY 2",
)
def category_counts(t):
    return drift.category_counts(orders(t), ["o_orderpriority"])


# ── whole reports ────────────────────────────────────────────────────────────


def _report(t):
    return reports.drift_report(orders(t), "o_totalprice", "o_orderpriority")


def _same_schema_sql(rows: str, types: dict[str, str]) -> str:
    """Schema comparison of two snapshots with the same columns."""
    columns = ", ".join(f"('common_column', '{c}', '{t}', '{t}', CAST(NULL AS DOUBLE))" for c, t in types.items())
    b, a = f"count(*) {_B}", f"count(*) {_A}"
    return (
        f"SELECT * FROM (VALUES {columns}) v(kind, \"column\", before, after, pct_change) UNION ALL"
        f" SELECT 'row_count', NULL, CAST({b} AS VARCHAR), CAST({a} AS VARCHAR), {_pct(b, a)} FROM {rows}"
    )


_ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
_PRIORITY_SEGMENTS = segments_sql(ORDERS, "o_orderpriority", "o_totalprice", "sum")


@query("d20_report_schema", _same_schema_sql(ORDERS, _ORDER_TYPES))
def report_schema(t):
    return _report(t)["schema"]


@query("d20_report_categories", _categories_sql(_ORDER_SHARES))
def report_categories(t):
    return _report(t)["categories"]


@query("d20_report_driver", _driver_sql(_PRIORITY_SEGMENTS))
def report_driver(t):
    return _report(t)["driver"]


@query("d20_report_driver_totals", _totals_sql(_PRIORITY_SEGMENTS))
def report_totals(t):
    return _report(t)["driver_totals"]


@query("d20_report_metrics", " UNION ALL ".join(_metric_sql(ORDERS, c) for c in ("o_orderkey", "o_custkey", "o_totalprice")))
def report_metrics(t):
    return reports.drift_report(orders(t), "o_totalprice", "o_orderpriority")["metrics"]


_DATED = {"o_orderpriority": "o_orderpriority", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"}
_STATUS = "(SELECT *, CASE o_orderstatus WHEN 'F' THEN 'before' ELSE 'after' END AS side FROM orders WHERE o_orderstatus IN ('F', 'O'))"


@query("d21_compare_groups_driver", _driver_sql(segments_sql(_STATUS, "o_orderpriority", "o_totalprice", "sum")))
def groups_driver(t):
    return reports.compare_groups(t.orders, "o_orderstatus", "F", "O", "o_totalprice", "o_orderpriority")["driver"]


@query("d21_compare_groups_categories", _categories_sql(_shares_sql(_STATUS, _DATED)))
def groups_categories(t):
    return reports.compare_groups(t.orders, "o_orderstatus", "F", "O")["categories"]


@query(
    "d23_default_choices",
    "SELECT 'o_orderstatus' AS split, 'o_orderkey' AS first_column, 'o_custkey' AS metric, 'o_orderstatus' AS segment"
    " FROM (SELECT count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderkey) AS k FROM orders) WHERE s BETWEEN 2 AND 20 AND k > 20",
)
def choices(t):
    pair = orders(t)
    found = (
        drift.suggest_split_column(t.orders),
        t.orders.columns[0],
        drift.suggest_metric_column(pair, exclude=("o_orderkey",)),
        drift.suggest_segment_column(pair),
    )
    return small_table(t.spark, [found], "split string, first_column string, metric string, segment string")
