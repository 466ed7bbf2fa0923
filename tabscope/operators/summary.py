"""Descriptive statistics of tables and single columns, and the numbers behind plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.columns import (
    as_text,
    is_datetime,
    is_nested,
    is_numeric,
    missing_as_null,
    ref,
    require,
    rows_of,
    small_table,
    text_of,
)
from tabscope.functions import late
from tabscope.functions.kernels import Moments, moments
from tabscope.functions.quantiles import exact_quantiles
from tabscope.functions.safe import share_pct
from tabscope.session import cut_lineage

TOP_VALUES = 10
PROFILE_BARS = 15
DEFAULT_BINS = 20
HUE_CATEGORIES = 8
FIT_POINTS = 100

_QUARTILES = [0.25, 0.5, 0.75]


def value_counts(df: DataFrame, column: str, top_n: int | None = TOP_VALUES) -> DataFrame:
    """Present values by frequency; equal counts in value order.

    The most frequent texts are chosen by hash and beginning, and fetched then.
    """
    require(df, column)
    value = text_of(df, column) if _nested(df, column) else ref(column)
    values = missing_as_null(df.select(value.alias("value"))).na.drop()
    if top_n is not None and isinstance(values.schema["value"].dataType, T.StringType):
        rows = late.text_rows(values, {column: ref("value")})
        groups = cut_lineage(late.grouped(rows, F.count("*").alias("count")))
        first = groups.orderBy(F.desc("count"), "beginning").limit(top_n).select("count", "beginning").collect()
        if not first:
            return groups.select(F.col("beginning").alias("value"), "count")
        # All that stand before the last of them, or beside it with the same beginning.
        n, beginning = F.lit(first[-1]["count"]), F.lit(first[-1]["beginning"])
        chosen = groups.filter((F.col("count") > n) | (F.col("count") == n) & (F.col("beginning") <= beginning))
        counts = late.with_values(chosen, rows).select("value", "count")
    else:
        counts = values.groupBy("value").agg(F.count("*").alias("count"))
    return counts if top_n is None else counts.orderBy(F.desc("count"), "value").limit(top_n)


def _nested(df: DataFrame, column: str) -> bool:
    return is_nested(df.schema[column].dataType)


def get_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column and statistic one row ``(column, dtype, statistic, number, text)``.

    Numbers have count, nulls, mean, std, min, quartiles and max; dates the same
    without std, as ISO text; text and truth values count, nulls, unique, top, freq.
    """
    df = missing_as_null(df.select(*[ref(c) for c in (columns or df.columns)]))
    fields = {f.name: f.dataType for f in df.schema}
    numbers = [c for c, t in fields.items() if is_numeric(t)]
    dates = [c for c, t in fields.items() if is_datetime(t)]
    others = [c for c in fields if c not in numbers and c not in dates]

    value = {c: ref(c).cast("double") for c in numbers}
    value |= {c: F.unix_micros(ref(c).cast("timestamp")).cast("double") for c in dates}
    found = {c: m for (_, c), m in moments(df, {c: value.get(c, F.when(ref(c).isNotNull(), 1.0)) for c in fields}).items()}
    nothing = Moments(0, 0, 0.0, 0.0, None, None)
    figures = {c: found.get(c, nothing) for c in fields}

    measured = {c: v for c, v in value.items() if figures[c].n}
    quartiles = exact_quantiles(df, measured, _QUARTILES, {c: figures[c].n for c in measured})

    records: list[tuple] = []
    for c, m in figures.items():
        dtype = fields[c].simpleString()
        records += [(c, dtype, "count", float(m.n), None), (c, dtype, "nulls", float(m.rows - m.n), None)]
        if c in measured:
            names = ["mean", "min", "25%", "50%", "75%", "max"]
            numbers_of = [m.mean, m.low, *quartiles[c], m.high]
            if c in numbers:
                names, numbers_of = [*names, "std"], [*numbers_of, m.std]
            records += [(c, dtype, s, v, None) for s, v in zip(names, numbers_of, strict=True)]
    schema = "column string, dtype string, statistic string, number double, text string"
    table = small_table(df.sparkSession, records, schema)
    if dates:
        stamp = F.date_format(F.timestamp_micros(F.col("number").cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        is_stamp = F.col("column").isin(dates) & ~F.col("statistic").isin("count", "nulls")
        table = table.withColumn("text", F.when(is_stamp, stamp)).withColumn(
            "number", F.when(~is_stamp, F.col("number"))
        )
    if others:
        tops = top_values(df, others)
        nothing = F.lit(None).cast("string")
        record = lambda statistic, number, text: F.struct(
            F.lit(statistic).alias("statistic"), number.alias("number"), text.alias("text")
        )
        dtype_of = F.create_map(*[F.lit(x) for c in others for x in (c, fields[c].simpleString())])
        table = table.unionByName(
            tops.select(
                "column",
                dtype_of[F.col("column")].alias("dtype"),
                F.inline(
                    F.array(
                        record("unique", F.col("n_distinct").cast("double"), nothing),
                        record("top", nothing.cast("double"), F.col("top")),
                        record("freq", F.col("freq").cast("double"), nothing),
                    )
                ),
            )
        )
    return table


def top_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct count, most frequent value and its frequency of each column; of equal counts the first value.

    Texts are grouped by hash: what is shuffled does not grow with their length.
    """
    rows = late.text_rows(df, {c: text_of(df, c) for c in columns})
    # Both uses of the groups are in one plan, which makes the shuffle once.
    groups = late.grouped(rows, F.count("*").alias("count"))
    best = groups.groupBy("column").agg(F.count("*").alias("n_distinct"), F.min(F.struct(-F.col("count"), F.col("beginning"))).alias("best"))
    # One row per column.
    chosen = groups.join(F.broadcast(best), "column").filter(F.struct(-F.col("count"), F.col("beginning")) == F.col("best")).drop("best")
    texts = late.with_values(chosen, rows)
    return texts.groupBy("column").agg(F.max("n_distinct").alias("n_distinct"), F.min("value").alias("top"), F.max("count").alias("freq"))


# ── one column ───────────────────────────────────────────────────────────────


def profile_column(df: DataFrame, column: str) -> DataFrame:
    """Everything about one column as rows ``(statistic, value, number)``."""
    require(df, column)
    dtype = df.schema[column].dataType
    one = missing_as_null(df.select(ref(column).alias("v")))
    v = F.col("v")
    nothing = F.lit(None).cast("string")

    counted = one.agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("m"))
    rows = rows_of(
        counted,
        [
            [F.lit("count"), nothing, F.col("n").cast("double")],
            [F.lit("missing"), nothing, F.col("m").cast("double")],
            [F.lit("missing_pct"), nothing, F.coalesce(share_pct(F.col("m"), F.col("n")), F.lit(0.0))],
        ],
        ["statistic", "value", "number"],
    )
    if isinstance(dtype, T.BooleanType):
        kind, more = "boolean", _frequency_rows(value_counts(df, column, None))
    elif is_numeric(dtype):
        kind, more = "numeric", _number_profile(one)
    elif is_datetime(dtype):
        iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        ends = one.agg(F.min(v).alias("a"), F.max(v).alias("b")).filter("a is not null")
        number = F.lit(None).cast("double")
        kind, more = "datetime", rows_of(
            ends,
            [[F.lit("min"), iso(F.col("a")), number], [F.lit("max"), iso(F.col("b")), number]],
            ["statistic", "value", "number"],
        )
    else:
        kind = "categorical"
        top = _frequency_rows(value_counts(df, column, TOP_VALUES))
        if is_nested(dtype):
            distinct = one.agg(F.lit(None).cast("double").alias("number"))
        else:
            # Two hashes stand for a value: what is shuffled does not grow with its length.
            different = one.filter(v.isNotNull()).select(F.xxhash64(v).alias("h"), F.xxhash64(F.lit("second"), v).alias("g")).distinct()
            distinct = different.agg(F.count("*").cast("double").alias("number"))
        more = top.unionByName(distinct.select(F.lit("unique").alias("statistic"), nothing.alias("value"), "number"))
    return rows.unionByName(more).select(
        F.lit(column).alias("column"), F.lit(kind).alias("kind"), "statistic", "value", "number"
    )


def _frequency_rows(counts: DataFrame) -> DataFrame:
    return counts.select(
        F.lit("frequency").alias("statistic"),
        F.col("value").cast("string").alias("value"),
        F.col("count").cast("double").alias("number"),
    )


def _number_profile(one: DataFrame) -> DataFrame:
    v = F.col("v").cast("double")
    row = one.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    ).first()
    records = []
    if row["n"]:
        p25, median, p75 = exact_quantiles(one, {"v": v}, _QUARTILES, {"v": row["n"]})["v"]
        spread = 0.0 if row["n"] == 1 else row["std"]
        found = {"mean": row["mean"], "median": median, "std": spread, "min": row["min"], "p25": p25, "p75": p75, "max": row["max"]}
        records = [(name, None, number) for name, number in found.items()]
    return small_table(one.sparkSession, records, "statistic string, value string, number double")


# ── chart data ───────────────────────────────────────────────────────────────


def histogram(df: DataFrame, column: str, bins: int = DEFAULT_BINS) -> DataFrame:
    """Equal-width bins from smallest to largest value; the last one includes its right edge."""
    require(df, column)
    values = missing_as_null(df.select(ref(column).cast("double").alias("v"))).na.drop()
    low, high = values.agg(F.min("v"), F.max("v")).first()
    schema = "bin bigint, left_edge double, right_edge double, count bigint"
    if low is None:
        return small_table(df.sparkSession, [], schema)
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    counted = values.groupBy(
        F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("bigint").alias("bin")
    ).agg(F.count("*").alias("n"))
    # `bins` rows at most on either side.
    return (
        df.sparkSession.range(bins)
        .withColumnRenamed("id", "bin")
        .join(counted, "bin", "left")
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("left_edge"),
            (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("right_edge"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
        )
    )


def profile_histogram(df: DataFrame, column: str) -> DataFrame:
    """Histogram with a bin per distinct value, but no fewer than 5 and no more than 30."""
    require(df, column)
    # Only up to 30 does the number matter: a sketch tells whether counting is worth it.
    values = missing_as_null(df.select(ref(column).alias("v")))
    distinct = values.agg(F.approx_count_distinct("v")).first()[0]
    if distinct <= 100:
        distinct = values.agg(F.count_distinct("v")).first()[0]
    return histogram(df, column, min(30, max(5, distinct)))


def bars(df: DataFrame, column: str, top_n: int = TOP_VALUES) -> DataFrame:
    return value_counts(df, column, top_n)


def profile_bars(df: DataFrame, column: str) -> DataFrame | None:
    """Bars of a column profile; None for nested values or when nothing is present."""
    if _nested(df, column):
        return None
    counts = value_counts(df, column, PROFILE_BARS)
    return None if counts.isEmpty() else counts


def scatter_points(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Points to draw. With ``hue``, its eight most frequent values keep their name, the rest are "Other"."""
    require(df, x, y)
    points = [ref(x).alias("x"), ref(y).alias("y")]
    if hue is None or hue not in df.columns:
        return missing_as_null(df).select(*points)
    top = [row["value"] for row in value_counts(df, hue, HUE_CATEGORIES).collect()]
    label = as_text(ref(hue), df.schema[hue].dataType)
    known = label if not top else F.when(ref(hue).isin(top), label).otherwise(F.lit("Other"))
    return missing_as_null(df).filter(ref(hue).isNotNull()).select(*points, known.alias("hue"))


def fit_line_points(fit: DataFrame, n: int = FIT_POINTS) -> DataFrame:
    """Evenly spaced points on the line of a :func:`linear_fit` row, from smallest to largest x."""
    step = F.try_divide(F.col("x_max") - F.col("x_min"), F.lit(n - 1))
    return (
        fit.filter("applicable")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point"))
        .select("point", (F.col("x_min") + F.col("point") * step).alias("x"), "slope", "intercept")
        .select("point", "x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"))
    )

