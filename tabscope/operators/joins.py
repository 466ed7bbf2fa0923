"""Equi-joins on one key, with the numbers that tell whether the join is a good idea."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.columns import is_nested, is_text, missing_as_null, ref, require
from tabscope.functions.safe import tidy
from tabscope.session import cut_lineage

JOIN_TYPES = ("inner", "left", "right", "outer")
# Rows of one key that a task takes without trouble, and hot keys that are sent to every task.
HOT_KEY_ROWS = 1_000_000
BROADCAST_KEYS = 100_000


def suggest_join_keys(a: DataFrame, b: DataFrame) -> list[tuple[int, str]]:
    """Shared columns as (rank, name): names that look like keys have rank 0."""

    def rank(name: str) -> int:
        lowered = name.lower()
        return 0 if lowered == "key" or lowered.endswith("id") else 1

    return sorted((rank(c), c) for c in a.columns if c in b.columns)


def join_dataframes(
    a: DataFrame, b: DataFrame, left_on: str, right_on: str, how: str = "inner", hot_key_rows: int | None = None, histogram: DataFrame | None = None
) -> DataFrame:
    """Join on equal keys, where a missing key equals a missing key.

    Equal key names give one key column; other shared names get ``_a`` / ``_b``.

    Spark picks broadcast or sort-merge by size, and adaptive execution splits
    hot keys of an inner join on either side. It cannot split the optional side
    of a left or right join, nor any side of a full join. With the keys'
    ``histogram`` (:func:`key_histogram`, which is also what sizes a join before
    it is run) at hand, keys with more than ``hot_key_rows`` rows on a side are
    taken out: those on both sides are an inner join, since every row has a
    match, and those on one side need no join at all. The result is the same.
    ``hot_key_rows`` without a histogram has one counted.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"no such join: {how}")
    require(a, left_on)
    require(b, right_on)
    if is_nested(a.schema[left_on].dataType) or is_nested(b.schema[right_on].dataType):
        raise TypeError("nested values cannot be join keys")
    if is_text(a.schema[left_on].dataType) != is_text(b.schema[right_on].dataType):
        raise TypeError(f"cannot match text with non-text keys: {left_on}, {right_on}")
    a, b, key_a, key_b, output = _renamed(missing_as_null(a), missing_as_null(b), left_on, right_on)
    match = a[key_a].eqNullSafe(b[key_b])

    kind = {"outer": "full"}.get(how, how)
    if how == "inner" or (histogram is None and hot_key_rows is None):
        return a.join(b, match, kind).select(*output)
    limit = HOT_KEY_ROWS if hot_key_rows is None else hot_key_rows
    histogram = histogram if histogram is not None else _histogram(a, b, key_a, key_b)
    # So few that each has more than the limit of rows: they are stored, counted and then sent to every task.
    hot = cut_lineage(histogram.filter(F.greatest("n_a", "n_b") > limit).select(F.col("key").alias("__key"), "n_a", "n_b"))
    n_hot = hot.count()
    if not n_hot:
        return a.join(b, match, kind).select(*output)
    hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
    both, only_a, only_b = hot.filter("n_a > 0 AND n_b > 0"), hot.filter("n_b = 0"), hot.filter("n_a = 0")

    def rows(df: DataFrame, key: str, keys: DataFrame, join: str) -> DataFrame:
        return df.join(keys.select("__key"), df[key].eqNullSafe(keys["__key"]), join)

    cold_a, cold_b = rows(a, key_a, hot, "left_anti"), rows(b, key_b, hot, "left_anti")
    hot_a, hot_b = rows(a, key_a, both, "left_semi"), rows(b, key_b, both, "left_semi")
    parts = [cold_a.join(cold_b, F.col(key_a).eqNullSafe(F.col(key_b)), kind), hot_a.join(hot_b, F.col(key_a).eqNullSafe(F.col(key_b)), "inner")]
    if how in ("left", "outer"):
        parts.append(_alone(rows(a, key_a, only_a, "left_semi"), b))
    if how in ("right", "outer"):
        parts.append(_alone(rows(b, key_b, only_b, "left_semi"), a))
    return reduce(DataFrame.unionByName, [p.select(*output) for p in parts])


def key_histogram(a: DataFrame, b: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """``key``, ``n_a``, ``n_b``: rows of each key on both sides, 0 where a side has none; missing keys are one key."""
    require(a, left_on)
    require(b, right_on)
    return _histogram(missing_as_null(a.select(ref(left_on).alias("ka"))), missing_as_null(b.select(ref(right_on).alias("kb"))), "ka", "kb")


def _histogram(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Counts of one side at a time meet in one more sum, so both combine before the shuffle."""
    one, none = F.lit(1), F.lit(0)
    sides = a.select(F.col(key_a).alias("key"), one.alias("n_a"), none.alias("n_b")).union(b.select(F.col(key_b), none, one))
    return sides.groupBy("key").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))


def _renamed(a: DataFrame, b: DataFrame, left_on: str, right_on: str):
    """Give all columns of both tables distinct names, and say how to build the output from them."""
    same_key = left_on == right_on
    shared = (set(a.columns) & set(b.columns)) - ({left_on} if same_key else set())
    final_a = [c + "_a" if c in shared else c for c in a.columns]
    final_b = [c + "_b" if c in shared else c for c in b.columns]
    inner_a = [f"__a{i}" for i in range(len(final_a))]
    inner_b = [f"__b{i}" for i in range(len(final_b))]
    key_a, key_b = inner_a[a.columns.index(left_on)], inner_b[b.columns.index(right_on)]
    output: list[Column] = []
    for inner, final in [*zip(inner_a, final_a), *zip(inner_b, final_b)]:
        if same_key and inner == key_a:
            output.append(F.coalesce(F.col(key_a), F.col(key_b)).alias(final))
        elif not (same_key and inner == key_b):
            output.append(F.col(inner).alias(final))
    return a.toDF(*inner_a), b.toDF(*inner_b), key_a, key_b, output


def _alone(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows without a match: the other side's columns are null."""
    return one.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema])


def join_stats(a: DataFrame, b: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """One row per join type: sizes, the rows the join would give, the key match rate.

    Computed from the two key histograms alone, so a join that would explode or
    lose nearly everything is known before it is run. ``null_pairs`` is the part
    of the result that comes from missing keys meeting each other.
    """
    require(a, left_on)
    require(b, right_on)
    shared = set(a.columns) & set(b.columns)
    columns = len(a.columns) + len(b.columns) - (1 if left_on == right_on and left_on in shared else 0)
    nested = is_nested(a.schema[left_on].dataType) or is_nested(b.schema[right_on].dataType)
    if nested:
        return _nested_key_stats(a, b, columns)
    a, b = missing_as_null(a.select(ref(left_on).alias("ka"))), missing_as_null(b.select(ref(right_on).alias("kb")))
    if is_text(a.schema["ka"].dataType) != is_text(b.schema["kb"].dataType):
        # Text never equals a number; only missing keys meet.
        a, b = (df.select(F.concat(F.lit(k), ref(k).cast("string")).alias(k)) for df, k in ((a, "ka"), (b, "kb")))
    ha = a.groupBy("ka").agg(F.count("*").alias("ca"))
    hb = b.groupBy("kb").agg(F.count("*").alias("cb"))
    keys = ha.join(hb, ha["ka"].eqNullSafe(hb["kb"]), "full").select(
        "ka", "kb", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("cb", F.lit(0)).alias("cb")
    )
    ca, cb = F.col("ca"), F.col("cb")
    # Products of counts can pass 2**63 for a join that explodes; decimal sums do not wrap.
    pairs = ca.cast("decimal(19,0)") * cb.cast("decimal(19,0)")
    big = lambda c: F.coalesce(F.sum(c), F.lit(0))
    facts = keys.agg(
        big(ca).alias("rows_a"),
        big(cb).alias("rows_b"),
        big(pairs).alias("inner"),
        big(F.when(cb == 0, ca)).alias("only_a"),
        big(F.when(ca == 0, cb)).alias("only_b"),
        big(F.when(F.col("ka").isNull() & F.col("kb").isNull(), pairs)).alias("null_pairs"),
        F.count("ka").alias("keys_a"),
        F.count_if(F.col("ka").isNotNull() & F.col("kb").isNotNull()).alias("keys_both"),
    )
    inner, only_a, only_b = F.col("inner"), F.col("only_a"), F.col("only_b")
    totals = {"inner": inner, "left": inner + only_a, "right": inner + only_b, "outer": inner + only_a + only_b}
    rate = F.coalesce(tidy(F.try_divide(F.col("keys_both"), F.col("keys_a")), 4), F.lit(0.0))
    return facts.select(
        F.inline(
            F.array(*[F.struct(F.lit(h).alias("how"), t.cast("double").alias("rows_result")) for h, t in totals.items()])
        ),
        F.col("rows_a"),
        F.col("rows_b"),
        F.lit(columns).cast("bigint").alias("columns_result"),
        rate.alias("match_rate"),
        F.col("null_pairs").cast("double").alias("null_pairs"),
    )


def _nested_key_stats(a: DataFrame, b: DataFrame, columns: int) -> DataFrame:
    """Nested keys cannot be matched; only the sizes are known."""
    sizes = a.agg(F.count("*").alias("rows_a"), F.lit(None).cast("bigint").alias("rows_b")).unionByName(
        b.agg(F.lit(None).cast("bigint").alias("rows_a"), F.count("*").alias("rows_b"))
    )
    nothing = F.lit(None).cast("double")
    return sizes.agg(F.max("rows_a").alias("rows_a"), F.max("rows_b").alias("rows_b")).select(
        F.explode(F.array(*[F.lit(h) for h in JOIN_TYPES])).alias("how"),
        nothing.alias("rows_result"),
        "rows_a",
        "rows_b",
        F.lit(columns).cast("bigint").alias("columns_result"),
        nothing.alias("match_rate"),
        nothing.alias("null_pairs"),
    )
