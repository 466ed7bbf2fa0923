"""Queries on joins and key statistics."""

from __future__ import annotations

from tabscope.catalog import Derived, query
from tabscope.operators import joins

# A fifth of the orders has no customer key, and one customer has none either: missing meets missing.
# The shift by 300 leaves orders without customers and customers without orders.
SALES = Derived(
    "orders",
    (
        "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_custkey END AS custkey",
        "o_orderkey",
        "o_totalprice AS amount",
    ),
)
CLIENTS = Derived(
    "customer",
    (
        "CASE WHEN c_custkey = 1 THEN NULL ELSE c_custkey + 300 END AS custkey",
        "c_name",
        "c_acctbal AS amount",
    ),
)

_SHARED = "a.o_orderkey, a.amount AS amount_a, b.c_name, b.amount AS amount_b"


def _join(how: str, sql_how: str, key: str):
    @query(
        f"c1_join_{how}",
        f"SELECT {key} AS custkey, {_SHARED} FROM {SALES.sql} a {sql_how} JOIN {CLIENTS.sql} b"
        " ON a.custkey IS NOT DISTINCT FROM b.custkey",
    )
    def _(t):
        return joins.join_dataframes(t.derived(SALES), t.derived(CLIENTS), "custkey", "custkey", how)


_join("inner", "INNER", "a.custkey")
_join("left", "LEFT", "a.custkey")
_join("right", "RIGHT", "b.custkey")


# Full joins on IS NOT DISTINCT FROM are written out, as not every engine plans them.
@query(
    "c1_join_outer",
    f"SELECT a.custkey, {_SHARED} FROM {SALES.sql} a LEFT JOIN {CLIENTS.sql} b ON a.custkey IS NOT DISTINCT FROM b.custkey"
    " UNION ALL SELECT b.custkey, NULL, NULL, b.c_name, b.amount"
    f" FROM {CLIENTS.sql} b WHERE NOT EXISTS (SELECT 1 FROM {SALES.sql} a WHERE a.custkey IS NOT DISTINCT FROM b.custkey)",
)
def outer(t):
    return joins.join_dataframes(t.derived(SALES), t.derived(CLIENTS), "custkey", "custkey", "outer")


@query(
    "c1_join_outer_hot_keys",
    f"SELECT a.custkey, {_SHARED} FROM {SALES.sql} a LEFT JOIN {CLIENTS.sql} b ON a.custkey IS NOT DISTINCT FROM b.custkey"
    " UNION ALL SELECT b.custkey, NULL, NULL, b.c_name, b.amount"
    f" FROM {CLIENTS.sql} b WHERE NOT EXISTS (SELECT 1 FROM {SALES.sql} a WHERE a.custkey IS NOT DISTINCT FROM b.custkey)",
)
def outer_hot(t):
    """The same join as planned when a key has too many rows for one task."""
    return joins.join_dataframes(t.derived(SALES), t.derived(CLIENTS), "custkey", "custkey", "outer", hot_key_rows=10)


@query(
    "c1_join_left_hot",
    "SELECT p.p_partkey, p.p_brand, l.l_partkey, l.l_orderkey, l.l_linenumber FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey",
)
def left_hot(t):
    """The optional side has the many rows; the histogram that sized the join names the keys to take out."""
    parts, lines = t.part.select("p_partkey", "p_brand"), t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber")
    histogram = joins.key_histogram(parts, lines, "p_partkey", "l_partkey")
    return joins.join_dataframes(parts, lines, "p_partkey", "l_partkey", "left", hot_key_rows=30, histogram=histogram)


@query(
    "c1_join_different_keys",
    "SELECT o.*, c.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
)
def different_keys(t):
    return joins.join_dataframes(t.orders, t.customer, "o_custkey", "c_custkey")


@query(
    "c3_join_stats",
    f"""WITH ha AS (SELECT custkey AS k, count(*) AS n FROM {SALES.sql} GROUP BY 1),
    hb AS (SELECT custkey AS k, count(*) AS n FROM {CLIENTS.sql} GROUP BY 1),
    f AS (SELECT (SELECT sum(n) FROM ha) AS rows_a, (SELECT sum(n) FROM hb) AS rows_b,
      (SELECT sum(ha.n * hb.n) FROM ha JOIN hb ON ha.k IS NOT DISTINCT FROM hb.k) AS pairs,
      (SELECT sum(n) FROM ha WHERE NOT EXISTS (SELECT 1 FROM hb WHERE ha.k IS NOT DISTINCT FROM hb.k)) AS only_a,
      (SELECT sum(n) FROM hb WHERE NOT EXISTS (SELECT 1 FROM ha WHERE ha.k IS NOT DISTINCT FROM hb.k)) AS only_b,
      (SELECT sum(ha.n * hb.n) FROM ha JOIN hb ON ha.k IS NULL AND hb.k IS NULL) AS null_pairs,
      (SELECT count(*) FROM ha JOIN hb ON ha.k = hb.k) AS both_keys, (SELECT count(k) FROM ha) AS keys_a)
    SELECT how, CAST(CASE how WHEN 'inner' THEN pairs WHEN 'left' THEN pairs + only_a WHEN 'right' THEN pairs + only_b
      ELSE pairs + only_a + only_b END AS DOUBLE) AS rows_result, CAST(rows_a AS BIGINT) AS rows_a,
      CAST(rows_b AS BIGINT) AS rows_b, CAST(5 AS BIGINT) AS columns_result,
      round(both_keys / keys_a, 4) AS match_rate, CAST(null_pairs AS DOUBLE) AS null_pairs
    FROM f, (VALUES ('inner'), ('left'), ('right'), ('outer')) v(how)""",
)
def stats(t):
    return joins.join_stats(t.derived(SALES), t.derived(CLIENTS), "custkey", "custkey")


@query(
    "c3_join_stats_other_type",
    """SELECT how, CAST(CASE how WHEN 'inner' THEN 0 WHEN 'left' THEN a WHEN 'right' THEN b ELSE a + b END AS DOUBLE) AS rows_result,
      a AS rows_a, b AS rows_b, CAST(11 AS BIGINT) AS columns_result, CAST(0 AS DOUBLE) AS match_rate, CAST(0 AS DOUBLE) AS null_pairs
    FROM (SELECT count(*) AS a FROM orders), (SELECT count(*) AS b FROM customer), (VALUES ('inner'), ('left'), ('right'), ('outer')) v(how)""",
)
def stats_of_other_type(t):
    """Names never equal numbers."""
    return joins.join_stats(t.orders, t.customer, "o_custkey", "c_name")


@query(
    "h3_key_overlap",
    f"SELECT DISTINCT custkey FROM {SALES.sql} WHERE custkey IN (SELECT custkey FROM {CLIENTS.sql})",
)
def key_overlap(t):
    return t.derived(SALES).select("custkey").na.drop().intersect(t.derived(CLIENTS).select("custkey"))
