"""Queries on data-quality problems, their fixes, and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import EVENTS_GAPS, ORDERS_GAPS, Derived, query, rounded
from tabscope.catalog.describing import REPEATED, _outlier_sql
from tabscope.functions.safe import tidy
from tabscope.operators import cleaning, pii

# Spaces around some texts; dates, numbers and short codes stored as text; constant and empty columns.
UNTIDY = Derived(
    "orders",
    (
        "o_orderkey",
        "CASE WHEN o_orderkey % 11 = 0 THEN concat(' ', o_orderpriority) WHEN o_orderkey % 13 = 0 THEN concat(o_orderpriority, '  ')"
        " WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS priority",
        "CASE WHEN o_orderkey % 4 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)"
        " WHEN o_orderkey % 4 = 1 THEN concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))"
        " WHEN o_orderkey % 4 = 2 THEN concat(CAST(year(o_orderdate) AS STRING), lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))"
        " WHEN o_orderkey % 101 = 3 THEN 'soon' ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:30:00') END AS ordered",
        "CASE WHEN o_orderkey % 50 = 7 THEN '1,000' WHEN o_orderkey % 50 = 8 THEN '12d' ELSE CAST(o_totalprice AS STRING) END AS amount",
        "CAST(10000 + o_custkey % 90000 AS STRING) AS zip",
        "'EUR' AS currency",
        "CAST(NULL AS STRING) AS remark",
    ),
)



def _issue_sql(**given: str) -> str:
    names = ["kind", "column", "count", "pct", "numeric", "lower", "upper", "value"]
    types = ["VARCHAR", "VARCHAR", "BIGINT", "DOUBLE", "BOOLEAN", "DOUBLE", "DOUBLE", "VARCHAR"]
    return "SELECT " + ", ".join(f'CAST({given.get(n, "NULL")} AS {t}) AS "{n}"' for n, t in zip(names, types))


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _tidy(table):
    return table.withColumn("lower", tidy("lower", 6)).withColumn("upper", tidy("upper", 6))


_DUPLICATES = (
    _issue_sql(kind="'duplicates'", count="d", pct=rounded("100.0 * d / n", 2))
    + f" FROM (SELECT sum(c) - count(*) AS d, sum(c) AS n FROM (SELECT count(*) AS c FROM {REPEATED.sql}"
    " GROUP BY l_linenumber, l_returnflag, discount)) WHERE d > 0"
)


@query("j1_detect_duplicates", _DUPLICATES)
def duplicates(t):
    return cleaning.detect_duplicates(t.derived(REPEATED))


def _missing_sql(view: str, columns: dict[str, bool]) -> str:
    return _union(
        _issue_sql(kind="'missing'", column=f"'{c}'", count="m", pct=rounded("100.0 * m / n", 2), numeric=str(numeric).lower())
        + f" FROM (SELECT count(*) - count({c}) AS m, count(*) AS n FROM {view}) WHERE m > 0"
        for c, numeric in columns.items()
    )


@query("j2_detect_missing", _missing_sql(ORDERS_GAPS.sql, {"price": True, "priority": False, "o_custkey": True}))
def missing(t):
    return cleaning.detect_missing(t.derived(ORDERS_GAPS))


def _outlier_issue_sql(view: str, columns: tuple[str, ...]) -> str:
    return _union(
        _issue_sql(kind="'outliers'", column='"column"', count="count", pct=rounded("100.0 * count / n_rows", 2),
                   lower=rounded("lower", 6), upper=rounded("upper", 6))
        + f" FROM ({_outlier_sql(view, c)}) WHERE count > 0"
        for c in columns
    )


@query("j3_detect_outliers", _outlier_issue_sql(EVENTS_GAPS.sql, ("event_id", "user_id", "value")))
def outliers(t):
    return _tidy(cleaning.detect_outliers(t.derived(EVENTS_GAPS)))


_WHITESPACE = (
    _issue_sql(kind="'whitespace'", column="'priority'", count="w", pct=rounded("100.0 * w / n", 2))
    + f" FROM (SELECT count(*) FILTER (WHERE priority <> trim(priority)) AS w, count(priority) AS n FROM {UNTIDY.sql}) WHERE w > 0"
)


@query("j4_detect_whitespace", _WHITESPACE)
def whitespace(t):
    return cleaning.detect_whitespace(t.derived(UNTIDY))


# What a date and a number may look like in UNTIDY, written out for the checking engine.
_DATE = (
    "coalesce(try_strptime({c}, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d']),"
    " CASE WHEN regexp_full_match({c}, '\\d{{8}}') THEN try_strptime({c}, '%Y%m%d') END,"
    " CASE WHEN regexp_full_match({c}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime({c}, ['%m/%d/%Y', '%d/%m/%Y']) END)"
)
_NUMBER = "CASE WHEN regexp_full_match(trim({c}), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST(trim({c}) AS DOUBLE) END"
_SHORT = "regexp_full_match(trim({c}), '\\d{{1,6}}')"
_TEXTS = ["priority", "ordered", "amount", "zip", "currency", "remark"]


def _shares_sql() -> str:
    share = "avg(CASE WHEN {c} IS NOT NULL THEN CASE WHEN {test} THEN 1.0 ELSE 0.0 END END)"
    parts = []
    for i, c in enumerate(_TEXTS):
        short, date, number = (
            share.format(c=c, test=x.format(c=c) + y) for x, y in ((_SHORT, ""), (_DATE, " IS NOT NULL"), (_NUMBER, " IS NOT NULL"))
        )
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", {short} AS short_digits, {date} AS dates, {number} AS numbers FROM {UNTIDY.sql}"
        )
    return "(" + _union(parts) + ")"


_LOOKS = "short_digits < 0.95 AND dates >= 0.95"


@query(
    "j5_j6_type_shares",
    f"SELECT position, \"column\", {rounded('short_digits', 6)} AS short_digits, {rounded('dates', 6)} AS dates,"
    f" {rounded('numbers', 6)} AS numbers, {_LOOKS} AS looks_datetime, numbers >= 0.95 AS looks_numeric FROM {_shares_sql()}",
)
def type_shares(t):
    table = cleaning.type_shares(t.derived(UNTIDY))
    return table.withColumns({c: tidy(c, 6) for c in ("short_digits", "dates", "numbers")})


_TYPES = (
    _issue_sql(kind=f"CASE WHEN {_LOOKS} THEN 'type_datetime' ELSE 'type_numeric' END", column='"column"')
    + f" FROM {_shares_sql()} WHERE ({_LOOKS}) OR numbers >= 0.95"
)


@query("j7_detect_type_issues", _TYPES)
def type_issues(t):
    return cleaning.detect_type_issues(t.derived(UNTIDY))


_CONSTANTS = _union(
    _issue_sql(kind="CASE WHEN n = 0 THEN 'empty_column' ELSE 'constant_column' END", column=f"'{c}'", value="v")
    + f" FROM (SELECT count({c}) AS n, count(DISTINCT {c}) AS d, min({c}) AS v FROM {UNTIDY.sql}) WHERE d <= 1"
    for c in _TEXTS
)


@query("j8_detect_constant_columns", _CONSTANTS)
def constants(t):
    return cleaning.detect_constant_columns(t.derived(UNTIDY))


@query("j9_detect_all_issues", _union([_missing_sql(UNTIDY.sql, {"priority": False, "remark": False}), _WHITESPACE, _TYPES, _CONSTANTS]))
def all_issues(t):
    return cleaning.detect_all_issues(t.derived(UNTIDY))


@query("j9_count_open_issues", f"SELECT count(*) AS open_issues FROM ({_outlier_issue_sql(EVENTS_GAPS.sql, ('event_id', 'user_id', 'value'))}"
       f" UNION ALL {_missing_sql(EVENTS_GAPS.sql, {'value': True, 'label': False})})")  # fmt: skip
def open_issues(t):
    return cleaning.count_open_issues(cleaning.detect_all_issues(t.derived(EVENTS_GAPS)))


# ── fixes ────────────────────────────────────────────────────────────────────


@query("j10_remove_duplicate_rows", f"SELECT DISTINCT * FROM {REPEATED.sql}")
def remove_duplicates(t):
    return cleaning.remove_duplicate_rows(t.derived(REPEATED))


@query(
    "j10_keep_first_by_key",
    "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1",
)
def keep_first(t):
    """The first order of each customer and priority."""
    return cleaning.keep_first(t.orders, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])


@query(
    "j10_keep_first_with_gaps",
    f"SELECT * FROM {EVENTS_GAPS.sql} QUALIFY row_number() OVER (PARTITION BY label, user_id ORDER BY value NULLS FIRST, event_id DESC) = 1",
)
def keep_first_gaps(t):
    """A missing label is a key like any other, a missing value comes first."""
    return cleaning.keep_first(t.derived(EVENTS_GAPS), ["label", "user_id"], ["value", -F.col("event_id")])


def _filled(fill: str, column: str = "value") -> str:
    others = {"value": "event_id, user_id, ts, event_type, label", "label": "event_id, user_id, ts, event_type, value"}[column]
    filled = f"coalesce({column}, ({fill}))"
    return f"SELECT {others}, {rounded(filled, 6) if column == 'value' else filled} AS {column} FROM {EVENTS_GAPS.sql}"


def _rounded_value(table):
    return table.withColumn("value", tidy("value", 6))


@query("j11a_fill_median", _filled(f"SELECT quantile_cont(CAST(value AS DOUBLE), 0.5) FROM {EVENTS_GAPS.sql}"))
def fill_median(t):
    return _rounded_value(cleaning.fill_missing(t.derived(EVENTS_GAPS), "value", "median"))


@query("j11b_fill_mean", _filled(f"SELECT avg(value) FROM {EVENTS_GAPS.sql}"))
def fill_mean(t):
    return _rounded_value(cleaning.fill_missing(t.derived(EVENTS_GAPS), "value", "mean"))


@query(
    "j11c_fill_mode",
    _filled(
        f"SELECT label FROM {EVENTS_GAPS.sql} WHERE label IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1", "label"
    ),
)
def fill_mode(t):
    return cleaning.fill_missing(t.derived(EVENTS_GAPS), "label", "mode")


@query("j11d_fill_zero", _filled("SELECT 0.0"))
def fill_zero(t):
    return _rounded_value(cleaning.fill_missing(t.derived(EVENTS_GAPS), "value", "zero"))


@query("j12_drop_missing_rows", f"SELECT * FROM {EVENTS_GAPS.sql} WHERE label IS NOT NULL")
def drop_missing(t):
    return cleaning.drop_missing_rows(t.derived(EVENTS_GAPS), "label")


_BOUNDS = (
    "(SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (SELECT quantile_cont(CAST(value AS DOUBLE), 0.25) AS q1,"
    f" quantile_cont(CAST(value AS DOUBLE), 0.75) AS q3 FROM {EVENTS_GAPS.sql}))"
)


@query(
    "j13_cap_outliers",
    f"SELECT event_id, user_id, ts, event_type, label, {rounded('CASE WHEN value < low THEN low WHEN value > high THEN high ELSE value END', 6)}"
    f" AS value FROM {EVENTS_GAPS.sql}, {_BOUNDS}",
)
def cap_outliers(t):
    return _rounded_value(cleaning.cap_outliers(t.derived(EVENTS_GAPS), "value"))


@query(
    "j14_remove_outlier_rows",
    f"SELECT event_id, user_id, ts, event_type, label, value FROM {EVENTS_GAPS.sql}, {_BOUNDS} WHERE value IS NULL OR value BETWEEN low AND high",
)
def remove_outliers(t):
    return cleaning.remove_outlier_rows(t.derived(EVENTS_GAPS), "value")


@query("j15_trim_whitespace", f"SELECT * REPLACE (trim(priority) AS priority) FROM {UNTIDY.sql}")
def trim(t):
    return cleaning.trim_whitespace(t.derived(UNTIDY), "priority")


@query("j16_convert_to_numeric", f"SELECT * REPLACE ({_NUMBER.format(c='amount')} AS amount) FROM {UNTIDY.sql}")
def to_numeric(t):
    return cleaning.convert_to_numeric(t.derived(UNTIDY), "amount")


@query(
    "j17_convert_to_datetime",
    f"SELECT o_orderkey, strftime({_DATE.format(c='ordered')}, '%Y-%m-%d %H:%M:%S') AS ordered FROM {UNTIDY.sql}",
)
def to_datetime(t):
    fixed = cleaning.convert_to_datetime(t.derived(UNTIDY), "ordered")
    return fixed.select("o_orderkey", F.date_format("ordered", "yyyy-MM-dd HH:mm:ss").alias("ordered"))


@query("j18_drop_column", f"SELECT * EXCLUDE (remark) FROM {UNTIDY.sql}")
def drop_column(t):
    return cleaning.drop_column(t.derived(UNTIDY), "remark")


@query(
    "j19_apply_fixes",
    f"SELECT o_orderkey, trim(priority) AS priority, {_NUMBER.format(c='amount')} AS amount, ordered, zip, currency FROM {UNTIDY.sql}"
    " WHERE priority IS NOT NULL",
)
def apply_fixes(t):
    return cleaning.apply_fixes(
        t.derived(UNTIDY),
        [
            ("trim_whitespace", {"column": "priority"}),
            ("drop_missing_rows", {"column": "priority"}),
            ("convert_to_numeric", {"column": "amount"}),
            ("drop_column", {"column": "remark"}),
        ],
    )


# ── personal data ────────────────────────────────────────────────────────────

# Card numbers: seven pairs "18", worth 10 each in the checksum, then a digit and the one that completes it.
_DIGIT = "(c_custkey % 10)"
_DOUBLED = f"(CASE WHEN {_DIGIT} >= 5 THEN {_DIGIT} * 2 - 9 ELSE {_DIGIT} * 2 END)"
PEOPLE = Derived(
    "customer",
    (
        "c_custkey",
        "c_name",
        "CASE WHEN c_custkey % 6 = 0 THEN 'unknown' ELSE concat(lower(c_mktsegment), CAST(c_custkey AS STRING), '@mail.example.com') END AS contact",
        "concat(' 555-', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-0199') AS phone",
        "concat(lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) AS tax_number",
        f"CASE WHEN c_nationkey = 3 THEN NULL ELSE concat('1818 1818 1818 18', CAST({_DIGIT} AS STRING), CAST((10 - {_DOUBLED} % 10) % 10 AS STRING)) END AS card",
        "concat('1234567890', lpad(CAST(c_custkey AS STRING), 6, '0')) AS account",
        "concat('10.', CAST(c_custkey % 256 AS STRING), '.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 300 AS STRING)) AS address",
        "concat('999.', CAST(c_custkey % 999 AS STRING), '.1.1') AS version",
        "concat('2024-01-', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')) AS joined",
    ),
)
_PEOPLE_TEXTS = ["c_name", "contact", "phone", "tax_number", "card", "account", "address", "version", "joined"]


def _rates_sql(view: Derived, texts: list[str]) -> str:
    share = "avg(CASE WHEN {among} THEN CASE WHEN {test} THEN 1.0 ELSE 0.0 END END)"
    parts = []
    for i, c in enumerate(texts):
        shape_card = "regexp_matches(v, '^\\d[\\d\\s-]{11,22}\\d$')"
        shape_ip = "regexp_matches(v, '^(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})$')"
        luhn = (
            "list_sum(list_transform(range(len(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[len(d) - i] AS INTEGER)"
            " ELSE CAST(d[len(d) - i] AS INTEGER) * 2 - CASE WHEN CAST(d[len(d) - i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
        )
        octets = "len(list_filter(string_split(v, '.'), lambda x: TRY_CAST(x AS INTEGER) > 255)) = 0"
        tests = {
            "email": ("v IS NOT NULL", "regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')"),
            "ssn": ("v IS NOT NULL", "regexp_matches(v, '^\\d{3}-\\d{2}-\\d{4}$')"),
            "card_shape": ("v IS NOT NULL", shape_card),
            "card_valid": (f"{shape_card} AND len(d) BETWEEN 13 AND 19", luhn),
            "ip_shape": ("v IS NOT NULL", shape_ip),
            "ip_valid": (shape_ip, octets),
            "phone": ("v IS NOT NULL", "regexp_matches(v, '[-\\s()+]') AND len(d) BETWEEN 7 AND 15"),
        }
        rates = ", ".join(f"{rounded(share.format(among=a, test=x), 6)} AS {n}" for n, (a, x) in tests.items())
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", {rates} FROM"
            f" (SELECT v, regexp_replace(v, '\\D', '', 'g') AS d FROM (SELECT trim({c}) AS v FROM {view.sql}))"
        )
    return _union(parts)


@query("k2_k6_pii_rates", _rates_sql(PEOPLE, _PEOPLE_TEXTS))
def rates(t):
    table = pii.pii_rates(t.derived(PEOPLE))
    return table.withColumns({name: tidy(name, 6) for name in pii.RATES})


def _kinds_sql(rates: str) -> str:
    return f"""SELECT "column", kind, label FROM (SELECT *, CASE WHEN email >= 0.8 THEN 'email' WHEN ssn >= 0.8 THEN 'ssn'
      WHEN card_shape >= 0.8 AND card_valid >= 0.8 THEN 'credit_card' WHEN ip_shape >= 0.8 AND ip_valid >= 0.8 THEN 'ip_address'
      WHEN phone >= 0.8 AND "column" <> 'joined' THEN 'phone' END AS kind FROM ({rates}))
    JOIN (VALUES ('email', 'Email address'), ('ssn', 'Social Security Number'), ('credit_card', 'Credit card number'),
      ('ip_address', 'IP address'), ('phone', 'Phone number')) v(k, label) ON kind = k"""


@query("k1_pii_columns", _kinds_sql(_rates_sql(PEOPLE, _PEOPLE_TEXTS)))
def personal_columns(t):
    return pii.detect_pii_columns(t.derived(PEOPLE))


# Pieces of whole texts: what stands around an @, the first long run of digits and marks between them, the first word.
PIECES = Derived(
    "documents",
    (
        "doc_id",
        "nullif(regexp_extract(text, '[^ \n]*@[^ \n]*', 0), '') AS contact",
        "nullif(regexp_extract(text, '[0-9][-0-9.()]{6,}', 0), '') AS number",
        "nullif(regexp_extract(text, '[^ \n]+', 0), '') AS word",
        "lang",
        "source",
    ),
)
_PIECE_TEXTS = ["contact", "number", "word", "lang", "source"]


@query("k2_k6_pii_rates_from_documents", _rates_sql(PIECES, _PIECE_TEXTS))
def document_rates(t):
    table = pii.pii_rates(t.derived(PIECES))
    return table.withColumns({name: tidy(name, 6) for name in pii.RATES})


@query("k1_pii_columns_from_documents", _kinds_sql(_rates_sql(PIECES, _PIECE_TEXTS)))
def document_pieces(t):
    return pii.detect_pii_columns(t.derived(PIECES))
