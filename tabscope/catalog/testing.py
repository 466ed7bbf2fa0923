"""Queries on significance tests.

The checks integrate the densities numerically (Simpson's rule, 2000 steps), a
different way than the library's continued fractions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import ORDERS_GAPS, changes, query, rounded
from tabscope.catalog.changes import LINES, ORDERS, lines, orders
from tabscope.functions.safe import tidy
from tabscope.operators import drift, significance
from tabscope.plans import reports

STEPS = 2000


def _integral(density: str, upper: str) -> str:
    """Integral of ``density`` in ``u`` from 0 to ``upper``, as a scalar over the columns at hand."""
    terms = (
        f"list_sum(list_transform(range({STEPS + 1}), lambda i: CASE WHEN i IN (0, {STEPS}) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
        f" * ({density.replace('{u}', f'(i * ({upper}) / {STEPS}.0)')})))"
    )
    return f"({terms} * ({upper}) / {STEPS}.0 / 3.0)"


def t_p_sql(t: str, dof: str) -> str:
    density = (
        f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0) - 0.5 * ln(pi() * {dof})"
        f" - ({dof} + 1) / 2.0 * ln(1 + {{u}} * {{u}} / {dof}))"
    )
    return f"greatest(0.0, 1 - 2 * {_integral(density, f'abs({t})')})"


def chi_p_sql(x: str, dof: str) -> str:
    # With x = u * u the density has no pole at 0, whatever the degrees of freedom.
    power = f"CASE WHEN {dof} = 1 THEN 1.0 ELSE pow({{u}}, {dof} - 1) END"
    density = f"2 * {power} * exp(-{{u}} * {{u}} / 2 - {dof} / 2.0 * ln(2) - lgamma({dof} / 2.0))"
    return f"greatest(0.0, 1 - {_integral(density, f'sqrt({x})')})"


def normal_p_sql(z: str) -> str:
    return f"greatest(0.0, 1 - 2 * {_integral('exp(-{u} * {u} / 2) / sqrt(2 * pi())', f'abs({z})')})"


def _welch_sql(rows: str, metric: str) -> str:
    b, a = "FILTER (WHERE side = 'before')", "FILTER (WHERE side = 'after')"
    return f"""SELECT '{metric}' AS metric, 'welch_t_test' AS test, true AS applicable, CAST(NULL AS VARCHAR) AS reason,
      {rounded('t', 4)} AS statistic, {rounded(t_p_sql('t', 'd'), 4)} AS p_value, CAST(0.05 AS DOUBLE) AS alpha,
      {t_p_sql('t', 'd')} < 0.05 AS significant, n1 AS n_before, n2 AS n_after
    FROM (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
        pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS d
      FROM (SELECT count({metric}) {b} AS n1, count({metric}) {a} AS n2, avg({metric}) {b} AS m1, avg({metric}) {a} AS m2,
        var_samp({metric}) {b} AS v1, var_samp({metric}) {a} AS v2 FROM {rows}))"""


def _test_rows(table):
    return table.withColumn("statistic", tidy("statistic", 4)).withColumn("p_value", tidy("p_value", 4))


@query("e1_welch", _welch_sql(LINES, "l_extendedprice"))
def welch(t):
    return _test_rows(significance.numeric_significance(lines(t), "l_extendedprice"))


@query("e1_welch_orders", _welch_sql(ORDERS, "o_totalprice"))
def welch_orders(t):
    return _test_rows(significance.numeric_significance(orders(t), "o_totalprice"))


def _welch_by_sql(rows: str, metric: str, segment: str) -> str:
    b, a = "FILTER (WHERE side = 'before')", "FILTER (WHERE side = 'after')"
    usable = "CASE WHEN n1 >= 2 AND n2 >= 2 THEN {} END"
    return f"""SELECT '{metric}' AS metric, '{segment}' AS "column", segment, 'welch_t_test' AS test, n1 >= 2 AND n2 >= 2 AS applicable,
      CASE WHEN n1 < 2 OR n2 < 2 THEN 'at least two values are needed on each side' END AS reason,
      {usable.format(rounded('t', 4))} AS statistic, {usable.format(rounded(t_p_sql('t', 'd'), 4))} AS p_value,
      {usable.format('CAST(0.05 AS DOUBLE)')} AS alpha, {usable.format(f"{t_p_sql('t', 'd')} < 0.05")} AS significant, n1 AS n_before, n2 AS n_after
    FROM (SELECT *, CASE WHEN n1 >= 2 AND n2 >= 2 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END AS t,
        CASE WHEN n1 >= 2 AND n2 >= 2 THEN pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) END AS d
      FROM (SELECT CAST({segment} AS VARCHAR) AS segment, count({metric}) {b} AS n1, count({metric}) {a} AS n2, avg({metric}) {b} AS m1, avg({metric}) {a} AS m2,
        var_samp({metric}) {b} AS v1, var_samp({metric}) {a} AS v2 FROM {rows} GROUP BY 1 HAVING count({metric}) > 0))"""


@query("e1_welch_by_segment", _welch_by_sql(LINES, "l_extendedprice", "l_returnflag"))
def welch_by_segment(t):
    return _test_rows(significance.segment_significance(lines(t), "l_extendedprice", "l_returnflag"))


@query("e1_welch_by_customer", _welch_by_sql(ORDERS, "o_totalprice", "o_custkey"))
def welch_by_customer(t):
    """A test for each customer; many have too few orders in a year."""
    return _test_rows(significance.segment_significance(orders(t), "o_totalprice", "o_custkey"))


def _chi_sql(rows: str, column: str) -> str:
    gap = "abs({o} - n * {t} / total)"
    cell = f"pow({gap} - least(CASE WHEN k = 2 THEN 0.5 ELSE 0.0 END, {gap}), 2) / (n * {{t}} / total)"
    cells = cell.format(o="b", t="tb") + " + " + cell.format(o="a", t="ta")
    return f"""SELECT '{column}' AS "column", 'chi_square' AS test, true AS applicable, CAST(NULL AS VARCHAR) AS reason,
      {rounded('x', 4)} AS statistic, {rounded(chi_p_sql('x', 'd'), 4)} AS p_value, CAST(d AS BIGINT) AS dof, CAST(0.05 AS DOUBLE) AS alpha,
      {chi_p_sql('x', 'd')} < 0.05 AS significant
    FROM (SELECT sum({cells}) AS x, any_value(k) - 1 AS d FROM
      (SELECT *, b + a AS n, CAST(sum(b) OVER () AS DOUBLE) AS tb, CAST(sum(a) OVER () AS DOUBLE) AS ta,
        CAST(sum(a + b) OVER () AS DOUBLE) AS total, count(*) OVER () AS k
       FROM (SELECT {column} AS c, count(*) FILTER (WHERE side = 'before') AS b, count(*) FILTER (WHERE side = 'after') AS a
         FROM {rows} WHERE {column} IS NOT NULL GROUP BY 1)))"""


@query("e2_chi_square", _chi_sql(ORDERS, "o_orderpriority"))
def chi_square(t):
    return _test_rows(significance.categorical_significance(orders(t), "o_orderpriority"))


@query("e2_chi_square_two_categories", _chi_sql(LINES, "l_linestatus"))
def chi_square_corrected(t):
    return _test_rows(significance.categorical_significance(lines(t), "l_linestatus"))


_STATUS_BY_PRIORITY = (
    "(SELECT *, CASE o_orderstatus WHEN 'F' THEN 'before' ELSE 'after' END AS side"
    f" FROM {ORDERS_GAPS.sql} WHERE o_orderstatus IN ('F', 'O'))"
)


@query("e2_chi_square_with_gaps", _chi_sql(_STATUS_BY_PRIORITY, "priority"))
def chi_square_gaps(t):
    pair = drift.split_by_column(t.derived(ORDERS_GAPS), "o_orderstatus", "F", "O")
    return _test_rows(significance.categorical_significance(pair, "priority"))


def _conversion_sql(counts: str, kept: str) -> str:
    z = 1.959963984540054
    return f"""SELECT {kept} count_a, total_a, count_b, total_b, se > 0 AS applicable,
      CASE WHEN se > 0 THEN NULL ELSE 'the pooled rate does not vary' END AS reason,
      CASE WHEN se > 0 THEN {rounded('ra', 4)} END AS rate_a, CASE WHEN se > 0 THEN {rounded('rb', 4)} END AS rate_b,
      CASE WHEN se > 0 THEN {rounded('rb - ra', 4)} END AS diff,
      CASE WHEN se > 0 THEN {rounded(f'rb - ra - {z} * so', 4)} END AS ci_low,
      CASE WHEN se > 0 THEN {rounded(f'rb - ra + {z} * so', 4)} END AS ci_high,
      CASE WHEN se > 0 THEN {rounded('zz', 4)} END AS z,
      CASE WHEN se > 0 THEN {rounded(normal_p_sql('zz'), 6)} END AS p_value,
      CASE WHEN se > 0 THEN {normal_p_sql('zz')} < 0.05 END AS significant, CASE WHEN se > 0 THEN CAST(0.05 AS DOUBLE) END AS alpha
    FROM (SELECT *, CASE WHEN se > 0 THEN (rb - ra) / se END AS zz FROM
      (SELECT *, sqrt(p * (1 - p) * (1.0 / total_a + 1.0 / total_b)) AS se,
         sqrt(ra * (1 - ra) / total_a + rb * (1 - rb) / total_b) AS so FROM
       (SELECT *, count_a / total_a AS ra, count_b / total_b AS rb,
          (count_a + count_b) / (total_a + total_b) AS p FROM {counts})))"""


# An experiment per day of the month: purchases among the events of odd and of even users.
_EXPERIMENTS = (
    "(SELECT day(ts) AS experiment, count(*) FILTER (WHERE user_id % 2 = 1 AND event_type = 'purchase') AS count_a,"
    " count(*) FILTER (WHERE user_id % 2 = 1) AS total_a,"
    " count(*) FILTER (WHERE user_id % 2 = 0 AND event_type = 'purchase') AS count_b,"
    " count(*) FILTER (WHERE user_id % 2 = 0) AS total_b FROM events GROUP BY 1)"
)


@query("e3_conversion_rates", _conversion_sql(_EXPERIMENTS, "CAST(experiment AS INTEGER) AS experiment,"))
def conversions(t):
    odd, bought = F.col("user_id") % 2 == 1, F.col("event_type") == "purchase"
    counts = t.events.groupBy(F.dayofmonth("ts").alias("experiment")).agg(
        F.count_if(odd & bought).alias("count_a"),
        F.count_if(odd).alias("total_a"),
        F.count_if(~odd & bought).alias("count_b"),
        F.count_if(~odd).alias("total_b"),
    )
    return significance.conversion_rates(counts)


@query(
    "e3_conversion_test",
    _conversion_sql(
        "(SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000) AS count_a,"
        " count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS total_a,"
        " count(*) FILTER (WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 5000) AS count_b,"
        " count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS total_b FROM customer)",
        "",
    ),
)
def conversion_test(t):
    rich = t.customer.withColumn("rich", F.col("c_acctbal") > 5000)
    return significance.conversion_test(rich, "c_mktsegment", "rich", "BUILDING", "MACHINERY")


def _fit_sql(view: str, x: str, y: str) -> str:
    return f"""SELECT true AS applicable, CAST(NULL AS VARCHAR) AS reason, n, {rounded('s', 6)} AS slope, {rounded('i', 4)} AS intercept,
      {rounded('r2', 6)} AS r2, {rounded(t_p_sql('t', 'd'), 4)} AS p_value, x_min, x_max
    FROM (SELECT *, n - 2.0 AS d, sqrt(r2 * (n - 2) / (1 - r2)) AS t FROM
      (SELECT CAST(regr_count({y}, {x}) AS BIGINT) AS n, regr_slope({y}, {x}) AS s, regr_intercept({y}, {x}) AS i, regr_r2({y}, {x}) AS r2,
        min({x}) AS x_min, max({x}) AS x_max FROM {view} WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"""


def _fit(table):
    return (
        table.withColumn("slope", tidy("slope", 6))
        .withColumn("intercept", tidy("intercept", 4))
        .withColumn("r2", tidy("r2", 6))
        .withColumn("p_value", tidy("p_value", 4))
    )


@query("e4_linear_fit", _fit_sql("lineitem", "l_quantity", "l_discount"))
def fit(t):
    return _fit(significance.linear_fit(t.lineitem, "l_quantity", "l_discount"))


@query("e4_linear_fit_with_gaps", _fit_sql("(SELECT price, CAST(o_custkey AS DOUBLE) AS customer FROM " + ORDERS_GAPS.sql + ")", "customer", "price"))
def fit_gaps(t):
    rows = t.derived(ORDERS_GAPS).selectExpr("price", "CAST(o_custkey AS DOUBLE) AS customer")
    return _fit(significance.linear_fit(rows, "customer", "price"))


# ── tests within whole reports ───────────────────────────────────────────────


@query("d20_report_metric_significance", _welch_sql(ORDERS, "o_totalprice"))
def report_metric_test(t):
    return _test_rows(reports.drift_report(orders(t), "o_totalprice", "o_orderpriority")["metric_significance"])


@query("d20_report_segment_significance", _chi_sql(ORDERS, "o_orderpriority"))
def report_segment_test(t):
    return _test_rows(reports.drift_report(orders(t), "o_totalprice", "o_orderpriority")["segment_significance"])


def _highlights_sql() -> str:
    """What each table of the report on line items gives to the reader."""
    none, dated = "CAST(NULL AS DOUBLE)", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"
    shares = changes._shares_sql(LINES, {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "l_shipdate": dated})
    segments = changes.segments_sql(LINES, "l_returnflag", "l_extendedprice", "sum")
    metrics = " UNION ALL ".join(changes._metric_sql(LINES, c) for c in changes._LINE_METRICS)
    rows = f"(SELECT count(*) FILTER (WHERE side = 'before') AS b, count(*) FILTER (WHERE side = 'after') AS a FROM {LINES})"
    verdict = "CASE WHEN significant THEN 'significant' ELSE 'not significant' END"
    parts = [
        f"SELECT 'row_count' AS kind, 'rows' AS subject, CAST(NULL AS VARCHAR) AS detail, CAST(b AS DOUBLE) AS before, CAST(a AS DOUBLE) AS after, {changes._pct('b', 'a')} AS change FROM {rows}",
        f"SELECT 'metric', \"column\", NULL, sum_before, sum_after, sum_pct_change FROM (SELECT * FROM ({metrics}) WHERE sum_pct_change <> 0 ORDER BY abs(sum_pct_change) DESC, \"column\" LIMIT 5)",
        f"SELECT 'category', \"column\", concat(kind, ': ', value), share_before, share_after, shift_pts FROM ({changes._categories_sql(shares)}) WHERE kind <> 'shift' OR rank <= 3",
        f"SELECT 'total', 'all segments', CASE WHEN mix_shift THEN 'mix shift' END, total_before, total_after, total_pct_change FROM ({changes._totals_sql(segments)})",
        f"SELECT 'driver', segment, CAST(contribution_pct AS VARCHAR), before, after, delta FROM (SELECT * FROM ({changes._driver_sql(segments)}) ORDER BY abs(delta) DESC, segment LIMIT 5)",
        f"SELECT 'test', metric, {verdict}, {none}, {none}, p_value FROM ({_welch_sql(LINES, 'l_extendedprice')})",
        f"SELECT 'test', \"column\", {verdict}, {none}, {none}, p_value FROM ({_chi_sql(LINES, 'l_returnflag')})",
    ]
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


@query("d22_highlights", _highlights_sql())
def highlights(t):
    found = reports.drift_highlights(reports.drift_report(lines(t), "l_extendedprice", "l_returnflag"))
    return found.withColumn("change", tidy("change", 4))


@query(
    "p2_any_significant",
    f"SELECT coalesce(bool_or(significant), false) AS significant FROM (SELECT significant FROM ({_welch_sql(LINES, 'l_extendedprice')})"
    f" UNION ALL SELECT significant FROM ({_chi_sql(LINES, 'l_returnflag')}))",
)
def any_significant(t):
    pair = lines(t)
    return significance.any_significant(
        significance.numeric_significance(pair, "l_extendedprice"),
        significance.categorical_significance(pair, "l_returnflag"),
    )
