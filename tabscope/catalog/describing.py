"""Queries on summaries, insights, profiles and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import EVENTS_GAPS, ORDERS_GAPS, Derived, query, rounded
from tabscope.functions.safe import tidy
from tabscope.operators import insights, significance, summary

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

GAPPY_LINES = Derived(
    "lineitem",
    (
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS quantity",
        "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS price",
        "l_discount",
        "l_tax",
        "CAST(1 AS DOUBLE) AS fixed",
    ),
)

REPEATED = Derived("lineitem", ("l_linenumber", "l_returnflag", "CASE WHEN l_tax > 0.04 THEN NULL ELSE l_discount END AS discount"))

NESTED_EVENTS = ("event_id", "event_type", "props")


def _nested(t):
    """Events with their JSON text opened into a struct."""
    return t.events.select("event_id", "event_type", F.from_json("props", "k int").alias("props"))


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# ── summary ──────────────────────────────────────────────────────────────────

_NUMBER_STATS = {
    "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})",
    "25%": "quantile_cont(CAST({c} AS DOUBLE), 0.25)", "50%": "quantile_cont(CAST({c} AS DOUBLE), 0.5)",
    "75%": "quantile_cont(CAST({c} AS DOUBLE), 0.75)",
}


def _summary_sql(view: str, numbers: dict[str, str], texts: dict[str, str], dates: dict[str, str]) -> str:
    parts = []
    row = "SELECT '{c}' AS \"column\", '{d}' AS dtype, '{s}' AS statistic, CAST({n} AS DOUBLE) AS number, {t} AS text FROM "
    for c, d in {**numbers, **texts, **dates}.items():
        parts.append(row.format(c=c, d=d, s="count", n=f"count({c})", t="NULL") + view)
        parts.append(row.format(c=c, d=d, s="nulls", n=f"count(*) - count({c})", t="NULL") + view)
    for c, d in numbers.items():
        for s, e in _NUMBER_STATS.items():
            parts.append(row.format(c=c, d=d, s=s, n=rounded(e.format(c=c), 6), t="NULL") + view)
    for c, d in dates.items():
        for s, e in _NUMBER_STATS.items():
            if s == "std":
                continue
            micros = e.format(c=f"epoch_us({c})")
            stamp = f"strftime(make_timestamp(CAST(trunc({micros} / 1000000) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S')"
            parts.append(row.format(c=c, d=d, s=s, n="NULL", t=stamp) + view)
    for c, d in texts.items():
        groups = f"(SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {view} WHERE {c} IS NOT NULL GROUP BY 1)"
        parts.append(row.format(c=c, d=d, s="unique", n="count(*)", t="NULL") + groups)
        parts.append(row.format(c=c, d=d, s="freq", n="max(n)", t="NULL") + groups)
        top = f"(SELECT v FROM {groups} ORDER BY n DESC, v LIMIT 1)"
        parts.append(f"SELECT '{c}', '{d}', 'top', NULL, v FROM {top}")
    return _union(parts)


@query(
    "d1_summary",
    _summary_sql(
        ORDERS_GAPS.sql,
        {"o_custkey": "bigint", "price": "double"},
        {"priority": "string", "o_orderstatus": "string", "flagged": "boolean"},
        {"o_orderdate": "timestamp_ntz"},
    ),
)
def whole_summary(t):
    names = ["o_custkey", "price", "priority", "o_orderstatus", "flagged", "o_orderdate"]
    table = summary.get_summary(t.derived(ORDERS_GAPS), names)
    return table.withColumn("number", tidy("number", 6)).withColumn("text", F.regexp_replace("text", r"\.\d{6}$", ""))


@query(
    "d2_value_counts",
    f"SELECT priority AS value, count(*) AS count FROM {ORDERS_GAPS.sql} WHERE priority IS NOT NULL"
    " GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def frequencies(t):
    return summary.value_counts(t.derived(ORDERS_GAPS), "priority")


@query(
    "d2_value_counts_many",
    "SELECT l_partkey AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def many_frequencies(t):
    return summary.value_counts(t.lineitem, "l_partkey")


def _pair_sql(view: str, names: list[str], digits: int) -> list[str]:
    """Correlation of each pair; DuckDB gives NaN where a column does not vary."""
    found = []
    for i, a in enumerate(names):
        for b in names[:i]:
            r = f"corr({a}, {b})"
            value = f"CASE WHEN isnan({r}) THEN NULL ELSE {rounded(f'CASE WHEN isnan({r}) THEN NULL ELSE {r} END', digits)} END"
            found.append(f"SELECT '{a}' AS \"column\", '{b}' AS column2, {value} AS correlation FROM {view}")
    return found


_GAPPY_NAMES = ["quantity", "price", "l_discount", "l_tax", "fixed"]


@query(
    "d3_correlation_matrix",
    f"WITH p AS ({_union(_pair_sql(GAPPY_LINES.sql, _GAPPY_NAMES, 4))})"
    " SELECT * FROM p UNION ALL SELECT column2, \"column\", correlation FROM p"
    " UNION ALL SELECT c, c, CASE WHEN c <> 'fixed' THEN 1.0 END FROM (VALUES ('quantity'), ('price'), ('l_discount'),"
    " ('l_tax'), ('fixed')) v(c)",
)
def matrix(t):
    return insights.correlation_matrix(t.derived(GAPPY_LINES))


NEAR_CONSTANT = Derived("customer", ("0.1D AS fixed", "c_acctbal", "CAST(c_nationkey AS DOUBLE) AS nation"))


@query(
    "d3_correlation_constant",
    "SELECT a AS \"column\", b AS column2, CASE WHEN a <> 'fixed' AND b <> 'fixed' THEN CASE WHEN a = b THEN 1.0 ELSE r END END AS correlation"
    f" FROM (SELECT {rounded('corr(c_acctbal, c_nationkey)', 4)} AS r FROM customer),"
    " (VALUES ('fixed'), ('c_acctbal'), ('nation')) x(a), (VALUES ('fixed'), ('c_acctbal'), ('nation')) y(b)",
)
def constant_beside_complete(t):
    """0.1 has no exact mean: the constant is complete like its neighbours and still has no correlation."""
    return insights.correlation_matrix(t.derived(NEAR_CONSTANT))


@query(
    "d4_shape",
    "SELECT count(*) AS rows, "
    + ", ".join(f"CAST({n} AS BIGINT) AS {c}" for c, n in {"columns": 6, "numeric": 3, "categorical": 2, "datetime": 1, "boolean": 0}.items())
    + " FROM orders",
)
def table_shape(t):
    return insights.shape(t.orders)


@query(
    "d5_missing_share",
    _union(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS count,"
        f" {rounded(f'100.0 * (count(*) - count({c})) / count(*)', 2)} AS pct FROM {ORDERS_GAPS.sql} HAVING count(*) > count({c})"
        for c in ("price", "priority", "o_custkey", "flagged")
    ),
)
def missing(t):
    return insights.missing_share(t.derived(ORDERS_GAPS))


_LINE_PAIRS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_NUMBERS]


@query(
    "d6_strongest_correlations",
    f"SELECT \"column\", column2, {rounded('r', 3)} AS correlation FROM ("
    + _union(
        f"SELECT '{a}' AS \"column\", '{b}' AS column2, corr({a}, {b}) AS r FROM lineitem"
        for i, a in enumerate(_LINE_PAIRS)
        for b in _LINE_PAIRS[:i]
    )
    + ") ORDER BY abs(r) DESC, 1, 2 LIMIT 5",
)
def strongest(t):
    return insights.strongest_correlations(t.lineitem)


def _outlier_sql(view: str, c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < low OR {c} > high) AS count, count({c}) AS n_values,"
        f" count(*) AS n_rows, any_value(low) AS lower, any_value(high) AS upper FROM {view} d,"
        f" (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM"
        f" (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {view}))"
    )


_OUTLIERS = f"({_outlier_sql(EVENTS_GAPS.sql, 'value')} UNION ALL {_outlier_sql(EVENTS_GAPS.sql, 'user_id')}" \
    f" UNION ALL {_outlier_sql(EVENTS_GAPS.sql, 'event_id')})"


@query(
    "d7_outlier_columns",
    f"SELECT \"column\", count, {rounded('100.0 * count / n_values', 2)} AS pct FROM {_OUTLIERS} WHERE count > 0"
    " ORDER BY count DESC, 1 LIMIT 5",
)
def outliers(t):
    return insights.outlier_columns(t.derived(EVENTS_GAPS))


@query("d8_high_cardinality", "SELECT 'c_name' AS \"column\" FROM customer HAVING count(DISTINCT c_name) > 0.9 * count(*)")
def identifiers(t):
    return insights.high_cardinality_columns(t.customer)


@query("d8_high_cardinality_nested", "SELECT 'props' AS \"column\"")
def nested_identifiers(t):
    return insights.high_cardinality_columns(_nested(t))


_LINE_COLUMNS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,"
    " l_returnflag, l_linestatus, l_shipdate"
)


@query(
    "d9_duplicate_rows",
    f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM"
    f" (SELECT count(*) AS n FROM {REPEATED.sql} GROUP BY l_linenumber, l_returnflag, discount)",
)
def duplicates(t):
    return insights.duplicate_rows(t.derived(REPEATED))


@query(
    "d9_duplicate_rows_wide",
    f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM"
    f" (SELECT count(*) AS n FROM lineitem GROUP BY {_LINE_COLUMNS})",
)
def wide_duplicates(t):
    return insights.duplicate_rows(t.lineitem.select(*_LINE_COLUMNS.replace(" ", "").split(",")))


@query(
    "d9_duplicate_rows_nested",
    "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM"
    " (SELECT count(*) AS n FROM events GROUP BY event_type, json_extract_string(props, '$.k'))",
)
def nested_duplicates(t):
    return insights.duplicate_rows(_nested(t).drop("event_id"))


@query(
    "d10_distinct_counts",
    _union(
        f"SELECT '{c}' AS \"column\", {e} AS n_distinct FROM events"
        for c, e in {
            "event_id": "count(DISTINCT event_id)", "event_type": "count(DISTINCT event_type)", "props": "CAST(NULL AS BIGINT)",
        }.items()
    ).replace("NULL AS BIGINT) AS n_distinct FROM events", "NULL AS BIGINT) AS n_distinct"),
)
def distinct(t):
    return insights.distinct_counts(_nested(t))


_INSIGHT = "SELECT '{kind}' AS kind, CAST({rank} AS INTEGER) AS rank, {c} AS \"column\", {c2} AS column2, {n} AS count, {v} AS value FROM {source}"


def _insights_sql() -> str:
    view = ORDERS_GAPS.sql
    sizes = [("boolean", "1"), ("categorical", "2"), ("columns", "7"), ("datetime", "1"), ("numeric", "3"), ("rows", "count(*)")]
    parts = [
        _INSIGHT.format(kind="shape", rank=i + 1, c=f"'{name}'", c2="NULL", n=f"CAST({n} AS BIGINT)", v="CAST(NULL AS DOUBLE)", source=view)
        if n == "count(*)"
        else _INSIGHT.format(kind="shape", rank=i + 1, c=f"'{name}'", c2="NULL", n=f"CAST({n} AS BIGINT)", v="CAST(NULL AS DOUBLE)", source="(SELECT 1)")
        for i, (name, n) in enumerate(sizes)
    ]
    gaps = _union(
        f"SELECT '{c}' AS c, count(*) - count({c}) AS n, {rounded(f'100.0 * (count(*) - count({c})) / count(*)', 2)} AS p FROM {view}"
        for c in ("price", "priority")
    )
    number = "row_number() OVER (ORDER BY n DESC, c)"
    parts.append(_INSIGHT.format(kind="missing", rank=number, c="c", c2="NULL", n="n", v="p", source=f"({gaps})"))
    pairs = _union(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {view}"
        for a, b in (("o_custkey", "o_orderkey"), ("price", "o_orderkey"), ("price", "o_custkey"))
    )
    parts.append(
        _INSIGHT.format(kind="correlation", rank="row_number() OVER (ORDER BY abs(r) DESC, a, b)", c="a", c2="b",
                        n="CAST(NULL AS BIGINT)", v=rounded("r", 3), source=f"({pairs})")
    )
    fences = _union(f"{_outlier_sql(view, c)}" for c in ("o_orderkey", "o_custkey", "price"))
    number = "row_number() OVER (ORDER BY count DESC, \"column\")"
    parts.append(
        _INSIGHT.format(kind="outliers", rank=number, c='"column"', c2="NULL", n="count",
                        v=rounded("100.0 * count / n_values", 2), source=f"({fences}) WHERE count > 0")
    )
    parts.append(
        _INSIGHT.format(kind="duplicates", rank=1, c="NULL", c2="NULL", n="CAST(0 AS BIGINT)", v="CAST(NULL AS DOUBLE)",
                        source=f"(SELECT count(*) - count(DISTINCT o_orderkey) AS d FROM {view}) WHERE d = 0")
    )
    return _union(parts)


@query("d11_insights", _insights_sql())
def all_insights(t):
    return insights.generate_insights(t.derived(ORDERS_GAPS))


# ── profiles ─────────────────────────────────────────────────────────────────


def _profile_sql(view: str, c: str, kind: str, more: list[str]) -> str:
    head = f"SELECT '{c}' AS \"column\", '{kind}' AS kind, "
    counts = [
        f"'count' AS statistic, CAST(NULL AS VARCHAR) AS value, CAST(count(*) AS DOUBLE) AS number FROM {view}",
        f"'missing', NULL, CAST(count(*) - count({c}) AS DOUBLE) FROM {view}",
        f"'missing_pct', NULL, {rounded(f'100.0 * (count(*) - count({c})) / count(*)', 2)} FROM {view}",
    ]
    return _union(head + part for part in counts + more)


@query(
    "d12a_profile_numeric",
    _profile_sql(
        ORDERS_GAPS.sql, "price", "numeric",
        [f"'{s}', NULL, {rounded(e.format(c='price'), 6)} FROM {ORDERS_GAPS.sql}" for s, e in {
            "mean": "avg({c})", "median": _NUMBER_STATS["50%"], "std": "stddev_samp({c})", "min": "min({c})",
            "p25": _NUMBER_STATS["25%"], "p75": _NUMBER_STATS["75%"], "max": "max({c})"}.items()],
    ),
)
def numeric_profile(t):
    return summary.profile_column(t.derived(ORDERS_GAPS), "price").withColumn("number", tidy("number", 6))


def _frequency_sql(view: str, c: str, limit: int | None) -> str:
    top = f" ORDER BY n DESC, v LIMIT {limit}" if limit else ""
    return (
        f"'frequency', v, CAST(n AS DOUBLE) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {view}"
        f" WHERE {c} IS NOT NULL GROUP BY 1{top})"
    )


@query("d12b_profile_boolean", _profile_sql(ORDERS_GAPS.sql, "flagged", "boolean", [_frequency_sql(ORDERS_GAPS.sql, "flagged", None)]))
def boolean_profile(t):
    return summary.profile_column(t.derived(ORDERS_GAPS), "flagged")


@query(
    "d12c_profile_datetime",
    _profile_sql(
        "events", "ts", "datetime",
        [f"'{f}', strftime({f}(ts), '%Y-%m-%dT%H:%M:%S'), NULL FROM events" for f in ("min", "max")],
    ),
)
def datetime_profile(t):
    return summary.profile_column(t.events, "ts")


@query(
    "d12d_profile_categorical",
    _profile_sql(
        "part", "p_type", "categorical",
        [_frequency_sql("part", "p_type", 10), "'unique', NULL, CAST(count(DISTINCT p_type) AS DOUBLE) FROM part"],
    ),
)
def categorical_profile(t):
    return summary.profile_column(t.part, "p_type")


# ── chart data ───────────────────────────────────────────────────────────────


def _histogram_sql(view: str, c: str, bins: str) -> str:
    return f"""WITH e AS (SELECT min({c}) AS low, max({c}) AS high, CAST({bins} AS INTEGER) AS bins FROM {view}),
    h AS (SELECT CAST(least(floor((CAST({c} AS DOUBLE) - low) / ((high - low) / bins)), bins - 1) AS BIGINT) AS bin,
      count(*) AS n FROM {view}, e WHERE {c} IS NOT NULL GROUP BY 1)
    SELECT r.bin, {rounded('low + r.bin * ((high - low) / bins)', 6)} AS left_edge,
      {rounded('low + (r.bin + 1) * ((high - low) / bins)', 6)} AS right_edge, coalesce(n, 0) AS count
    FROM (SELECT unnest(range(bins)) AS bin, low, high, bins FROM e) r LEFT JOIN h ON h.bin = r.bin"""


def _edges(table):
    return table.withColumn("left_edge", tidy("left_edge", 6)).withColumn("right_edge", tidy("right_edge", 6))


@query("q1_histogram", _histogram_sql(EVENTS_GAPS.sql, "value", "20"))
def values_histogram(t):
    return _edges(summary.histogram(t.derived(EVENTS_GAPS), "value"))


@query("q2_profile_histogram", _histogram_sql("lineitem", "l_linenumber", "least(30, greatest(5, count(DISTINCT l_linenumber)))"))
def short_histogram(t):
    return _edges(summary.profile_histogram(t.lineitem, "l_linenumber"))


@query("q3_bars", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def brand_bars(t):
    return summary.bars(t.part, "p_brand")


@query("q3_profile_bars", "SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def type_bars(t):
    return summary.profile_bars(t.part, "p_type")


@query(
    "q4_scatter_with_hue",
    "WITH top AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)"
    " SELECT c_custkey AS x, c_acctbal AS y, CASE WHEN c_nationkey IN (SELECT * FROM top)"
    " THEN CAST(c_nationkey AS VARCHAR) ELSE 'Other' END AS hue FROM customer WHERE c_nationkey IS NOT NULL",
)
def scatter(t):
    return summary.scatter_points(t.customer, "c_custkey", "c_acctbal", "c_nationkey")


_FIT = "SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i," \
    " min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem"


@query(
    "q5_fit_line",
    f"SELECT CAST(p AS INTEGER) AS point, {rounded('a + p * (b - a) / 99', 4)} AS x,"
    f" {rounded('i + s * (a + p * (b - a) / 99)', 4)} AS y FROM ({_FIT}), range(100) r(p)",
)
def fit_line(t):
    points = summary.fit_line_points(significance.linear_fit(t.lineitem, "l_quantity", "l_extendedprice"))
    return points.withColumn("x", tidy("x", 4)).withColumn("y", tidy("y", 4))


@query(
    "q6_heatmap",
    f"WITH p AS ({_union(_pair_sql('lineitem', LINE_NUMBERS, 4))})"
    " SELECT * FROM p UNION ALL SELECT column2, \"column\", correlation FROM p UNION ALL SELECT c, c, 1.0 FROM"
    " (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) v(c)",
)
def heatmap(t):
    return insights.correlation_matrix(t.lineitem, LINE_NUMBERS)
