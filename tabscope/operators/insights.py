"""What a table looks like: missing values, correlations, outliers, identifiers, duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.columns import (
    boolean_columns,
    categorical_columns,
    datetime_columns,
    missing_as_null,
    nested_columns,
    numeric_columns,
    ref,
    rows_of,
    small_table,
    text_columns,
    text_of,
)
from tabscope.functions.kernels import Moments, moments
from tabscope.functions.quantiles import exact_quantiles
from tabscope.functions.safe import share_pct, tidy
from tabscope.functions.text import has_edge_space

IDENTIFIER_SHARE = 0.9
FENCE = 1.5

# Columns with a single value that one pass reads: more would leave generated code too large to compile.
COLUMNS_AT_ONCE = 50
# Rows multiplied at once: some megabytes for a hundred columns.
ROWS_AT_ONCE = 4096
# Sketches with a ratio below this put a column far away from being an identifier.
CLEARLY_REPEATED = 0.5


@dataclass(frozen=True)
class Facts:
    """What one pass tells about every column; enough for several operators, so they need not read again."""

    rows: int
    present: dict[str, int]
    mean: dict[str, float | None]
    spaced: dict[str, int]
    constant: dict[str, str | None]


def gather_facts(df: DataFrame) -> Facts:
    """Present values, means, values with space around them, and single values, of all columns, however many.

    Every column is one or two numbers to the pass: its value or a hash of it,
    and whether a text has space around it. Columns that seem to have a single
    value are looked at once more, as they are.
    """
    clean = missing_as_null(df)
    numbers, texts, nested = set(numeric_columns(clean)), set(text_columns(clean)), set(nested_columns(clean))
    values: dict[str, Column] = {}
    for i, c in enumerate(clean.columns):
        if c in numbers:
            values[f"v{i}"] = ref(c).cast("double")
        elif c in nested:
            values[f"v{i}"] = F.when(ref(c).isNotNull(), 1.0)
        else:
            values[f"v{i}"] = F.when(ref(c).isNotNull(), F.xxhash64(ref(c)))
        if c in texts:
            values[f"w{i}"] = F.when(has_edge_space(ref(c)), 1.0)
    found = {name: m for (_, name), m in moments(clean, values).items()}
    at = {c: i for i, c in enumerate(clean.columns)}
    nothing = Moments(0, 0, 0.0, 0.0, None, None)
    of = lambda kind, c: found.get(f"{kind}{at[c]}", nothing)
    alike = [c for c in clean.columns if c not in nested and of("v", c).n and of("v", c).low == of("v", c).high]
    return Facts(
        rows=max((m.rows for m in found.values()), default=0),
        present={c: of("v", c).n for c in clean.columns},
        mean={c: of("v", c).mean for c in clean.columns if c in numbers},
        spaced={c: of("w", c).n for c in clean.columns if c in texts},
        constant=_single_values(clean, alike),
    )


def _single_values(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The value of each column that has only one; smallest equal to largest says so without counting."""
    found = {}
    for start in range(0, len(columns), COLUMNS_AT_ONCE):
        some = columns[start : start + COLUMNS_AT_ONCE]
        ends = [(F.min(ref(c)), F.max(ref(c))) for c in some]
        row = df.agg(*[F.when(low == high, low.cast("string")).alias(f"v{i}") for i, (low, high) in enumerate(ends)]).first()
        found |= {c: row[f"v{i}"] for i, c in enumerate(some) if row[f"v{i}"] is not None}
    return found


def shape(df: DataFrame) -> DataFrame:
    """Row and column counts, with the number of columns of each type class."""
    return df.agg(F.count("*").alias("rows")).select("rows", *_class_sizes(df))


def _class_sizes(df: DataFrame) -> list[Column]:
    sizes = {
        "columns": len(df.columns),
        "numeric": len(numeric_columns(df)),
        "categorical": len(categorical_columns(df)),
        "datetime": len(datetime_columns(df)),
        "boolean": len(boolean_columns(df)),
    }
    return [F.lit(n).cast("bigint").alias(name) for name, n in sizes.items()]


def missing_share(df: DataFrame, top: int | None = 5, facts: Facts | None = None) -> DataFrame:
    """Columns with missing values: how many and which share of the rows, most first."""
    facts = facts or gather_facts(df)
    found = [(c, facts.rows - n, facts.rows) for c, n in facts.present.items() if n < facts.rows]
    rows = small_table(df.sparkSession, found, "column string, count bigint, rows bigint")
    ranked = rows.select("column", "count", share_pct(F.col("count"), F.col("rows")).alias("pct"))
    ranked = ranked.orderBy(F.desc("count"), "column")
    return ranked if top is None else ranked.limit(top)


# ── correlations ─────────────────────────────────────────────────────────────


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, facts: Facts | None = None) -> DataFrame:
    """Pearson correlation of every pair of number columns, over the rows where both are present.

    Long form, one row per unordered pair (``column`` comes later in the table
    than ``column2``); null where a column does not vary. Two scans, whatever
    the number of columns and gaps: a first pass finds the means, a second the
    products of all columns about them.
    """
    columns = columns if columns is not None else numeric_columns(df)
    unfit = [c for c in columns if c not in numeric_columns(df)]
    if unfit:
        raise TypeError(f"not numeric: {unfit}")
    spark = df.sparkSession
    if len(columns) < 2:
        return small_table(spark, [], "column string, column2 string, correlation double")
    facts = facts or gather_facts(df.select(*[ref(c) for c in columns]))
    clean = missing_as_null(df.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    # A column with one value has no correlation; sums about a rounded mean would leave a residue.
    means = [facts.mean[c] if c not in facts.constant else None for c in columns]
    c = F.col
    # The values are centred already, so the corrections for the pair's own means are small.
    var_a = c("aa") - F.try_divide(c("a") * c("a"), c("n"))
    var_b = c("bb") - F.try_divide(c("b") * c("b"), c("n"))
    noise = 1e-12
    spread = F.when((var_a > c("aa") * noise) & (var_b > c("bb") * noise), F.sqrt(var_a) * F.sqrt(var_b))
    names = F.lit(columns)
    pairs = small_table(spark, [(i, j) for i in range(len(columns)) for j in range(i)], "i int, j int")
    return pairs.join(_products(clean, means), ["i", "j"], "left").select(
        names[c("i")].alias("column"), names[c("j")].alias("column2"), F.try_divide(c("ab") - F.try_divide(c("a") * c("b"), c("n")), spread).alias("correlation")
    )


def _products(df: DataFrame, means: list[float | None]) -> DataFrame:
    """Sums over the rows where both of two columns are present: ``n``, ``a``, ``b``, ``aa``, ``bb``, ``ab`` for each ``i`` > ``j``.

    ``a`` and ``b`` are the two values about their means; a column without a
    mean is left out. Each task multiplies its columns as matrices and sends one
    row per pair; these are summed by pair.
    """
    used = [i for i, mean in enumerate(means) if mean is not None]
    centre = np.array([means[i] for i in used])
    low, high = np.tril_indices(len(used), -1)
    place = np.array(used, dtype=np.int32)
    names = ["i", "j", "n", "a", "b", "aa", "bb", "ab"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, len(used), len(used)))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                x = np.array([part.column(k).to_numpy(zero_copy_only=False) for k in range(len(used))], dtype=float)
                there = ~np.isnan(x)
                x = np.where(there, x - centre[:, None], 0.0)
                there = there.astype(float)
                sums += [there @ there.T, x @ there.T, (x * x) @ there.T, x @ x.T]
        n, a, aa, ab = sums
        values = [n[low, high], a[low, high], a[high, low], aa[low, high], aa[high, low], ab[low, high]]
        yield pa.RecordBatch.from_arrays([pa.array(place[low]), pa.array(place[high]), *map(pa.array, values)], names=names)

    schema = "i int, j int, " + ", ".join(f"{n} double" for n in names[2:])
    partial = df.select(*[f"c{i}" for i in used]).mapInArrow(multiply, schema)
    return partial.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names[2:]])


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The full square matrix in long form, 4 decimals, ones on the diagonal of varying columns."""
    columns = columns if columns is not None else numeric_columns(df)
    pairs = correlation_pairs(df, columns).withColumn("correlation", tidy("correlation", 4))
    clean = missing_as_null(df.select(*[ref(c).cast("double").alias(c) for c in columns]))
    one = clean.agg(*[(F.max(ref(c)) > F.min(ref(c))).alias(f"v{i}") for i, c in enumerate(columns)])
    own = rows_of(
        one,
        [[F.lit(c), F.lit(c), F.when(F.col(f"v{i}"), F.lit(1.0))] for i, c in enumerate(columns)],
        ["column", "column2", "correlation"],
    )
    mirrored = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("column"), F.col("column2")),
                F.struct(F.col("column2").alias("column"), F.col("column").alias("column2")),
            )
        ),
        "correlation",
    )
    return mirrored.unionByName(own)


def _strongest(df: DataFrame, top: int, facts: Facts | None = None) -> DataFrame:
    pairs = correlation_pairs(df, facts=facts).filter(F.col("correlation").isNotNull())
    return pairs.orderBy(F.abs("correlation").desc(), "column", "column2").limit(top)


def strongest_correlations(df: DataFrame, top: int = 5) -> DataFrame:
    return _strongest(df, top).withColumn("correlation", tidy("correlation", 3))


# ── outliers ─────────────────────────────────────────────────────────────────


def tukey_fences(df: DataFrame, columns: list[str], facts: Facts | None = None) -> dict[str, tuple[float, float]]:
    """Lower and upper outlier bounds of each column that has a spread between its quartiles."""
    clean = missing_as_null(df.select(*[ref(c) for c in columns]))
    fences = {}
    for name, (q1, q3) in exact_quantiles(clean, columns, [0.25, 0.75], facts and facts.present).items():
        if q1 is not None and q3 != q1:
            fences[name] = (q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1))
    return fences


def outlier_counts(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Rows strictly outside the fences, per number column that has any, with both denominators."""
    fences = tukey_fences(df, numeric_columns(df), facts)
    names = ["column", "count", "n_values", "n_rows", "lower", "upper"]
    if not fences:
        return small_table(df.sparkSession, [], "column string, count bigint, n_values bigint, n_rows bigint, lower double, upper double"
        )
    clean = missing_as_null(df.select(*[ref(c) for c in fences]))
    aggregates = [F.count("*").alias("n")]
    records = []
    for i, (c, (low, high)) in enumerate(fences.items()):
        value = ref(c).cast("double")
        aggregates.append(F.count_if((value < low) | (value > high)).alias(f"o{i}"))
        aggregates.append(F.count(value).alias(f"v{i}"))
        records.append([F.lit(c), F.col(f"o{i}"), F.col(f"v{i}"), F.col("n"), F.lit(low), F.lit(high)])
    return rows_of(clean.agg(*aggregates), records, names).filter("count > 0")


def outlier_columns(df: DataFrame, top: int = 5, facts: Facts | None = None) -> DataFrame:
    """Columns with outliers; the share is of the present values."""
    return (
        outlier_counts(df, facts)
        .select("column", "count", share_pct(F.col("count"), F.col("n_values")).alias("pct"))
        .orderBy(F.desc("count"), "column")
        .limit(top)
    )


# ── distinct values and duplicates ───────────────────────────────────────────


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct present values per column; null for nested columns, which cannot be counted."""
    columns = columns if columns is not None else df.columns
    df = missing_as_null(df.select(*[ref(c) for c in columns]))
    nested = set(nested_columns(df))
    flat = [c for c in columns if c not in nested]
    counted = _distinct_values(df, flat)
    names = small_table(df.sparkSession, [(i, c, c in nested) for i, c in enumerate(columns)], "position int, column string, nested boolean")
    found = names.join(counted, "column", "left")
    return found.select("column", F.when(~F.col("nested"), F.coalesce("n_distinct", F.lit(0))).alias("n_distinct"))


def _distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_distinct) of columns with present values: two hashes of each value, combined before the one shuffle."""
    if not columns:
        return small_table(df.sparkSession, [], "column string, n_distinct bigint")
    each = [
        F.struct(F.lit(i).alias("i"), F.xxhash64(ref(c)).alias("h"), F.xxhash64(F.lit("second"), ref(c)).alias("g"), ref(c).isNotNull().alias("present"))
        for i, c in enumerate(columns)
    ]
    values = df.select(F.inline(F.array(*each))).filter("present").groupBy("i", "h", "g").agg(F.lit(1).alias("one"))
    return values.groupBy("i").agg(F.count("*").alias("n_distinct")).select(F.lit(columns)[F.col("i")].alias("column"), "n_distinct")


def high_cardinality_columns(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Text columns nearly every row of which has its own value, and all nested columns.

    A sketch only rules out columns that are far from the limit; all others are
    counted exactly, at every size.
    """
    error = 0.02
    texts = text_columns(df)
    found = list(nested_columns(df))
    if texts:
        clean = df.select(*[ref(c) for c in texts])
        n = facts.rows if facts else df.count()
        row = clean.agg(*[F.approx_count_distinct(ref(c), error).alias(f"d{i}") for i, c in enumerate(texts)]).first()
        doubtful = [c for i, c in enumerate(texts) if n and row[f"d{i}"] / n >= CLEARLY_REPEATED]
        counted = {r["column"]: r["n_distinct"] for r in _distinct_values(missing_as_null(clean), doubtful).collect()}
        found += [c for c in doubtful if counted.get(c, 0) > 1 and counted[c] / n > IDENTIFIER_SHARE]
    ordered = [(c,) for c in df.columns if c in found]
    return small_table(df.sparkSession, ordered, "column string")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier identical row (missing equals missing).

    Rows are told apart by two hashes of 64 bits, so 16 bytes for each
    different row are shuffled, however long the rows and however many repeat;
    counts of a row that very many tasks hold combine before it. Two different
    rows are taken for one with a chance of about 2**-128.
    """
    groups = row_hashes(df).groupBy("h", "g").agg(F.count("*").alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def row_hashes(df: DataFrame) -> DataFrame:
    """``h`` and ``g``, two hashes of each whole row; missing cells are alike, nested ones count by their JSON text."""
    clean = missing_as_null(df)
    cells = [_comparable(clean, c) for c in clean.columns]
    # Hashing skips nulls; the null pattern keeps (null, x) and (x, null) apart.
    pattern = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return clean.select(F.xxhash64(pattern, *cells).alias("h"), F.xxhash64(F.lit("second"), *cells, pattern).alias("g"))


def _comparable(df: DataFrame, name: str) -> Column:
    return text_of(df, name) if name in nested_columns(df) else ref(name)


def generate_insights(df: DataFrame, max_items: int = 5) -> DataFrame:
    """All of the above as one table ``(kind, rank, column, column2, count, value)``."""
    nothing = F.lit(None)
    text, number, whole = nothing.cast("string"), nothing.cast("double"), nothing.cast("bigint")

    def ranked(rows: DataFrame, kind: str, *order: Column, column=text, column2=text, count=whole, value=number):
        # At most `max_items` rows, or one per column, reach this window.
        rank = F.row_number().over(Window.orderBy(*order)) if order else F.lit(1)
        return rows.select(
            F.lit(kind).alias("kind"), rank.alias("rank"), column.alias("column"), column2.alias("column2"),
            count.cast("bigint").alias("count"), value.cast("double").alias("value"),
        )

    c, c2, n = F.col("column"), F.col("column2"), F.col("count")
    facts = gather_facts(df)
    sizes = small_table(df.sparkSession, [(facts.rows,)], "rows bigint").select("rows", *_class_sizes(df))
    parts = [
        ranked(
            rows_of(sizes, [[F.lit(name), F.col(name)] for name in sizes.columns], ["column", "count"]),
            "shape", c, column=c, count=n,
        ),
        ranked(missing_share(df, max_items, facts), "missing", n.desc(), c, column=c, count=n, value=F.col("pct")),
        ranked(
            _strongest(df, max_items, facts), "correlation", F.abs("correlation").desc(), c, c2,
            column=c, column2=c2, value=tidy("correlation", 3),
        ),
        ranked(outlier_columns(df, max_items, facts), "outliers", n.desc(), c, column=c, count=n, value=F.col("pct")),
        ranked(high_cardinality_columns(df, facts), "high_cardinality", c, column=c),
        ranked(duplicate_rows(df), "duplicates", count=F.col("duplicate_rows")),
    ]
    return reduce(DataFrame.unionByName, parts)
