"""Row and column selection."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.columns import equals, literal, missing_as_null, ref, require, text_of

PICKER_VALUES = 200

_COMPARISONS = {
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
}


def _predicate(df: DataFrame, name: str, op: str, value: Any) -> Column:
    require(df, name)
    if op == "contains":
        return text_of(df, name).rlike("(?i)" + str(value))
    if op == "eq":
        return equals(df, name, value)
    if op not in _COMPARISONS:
        raise ValueError(f"Unknown operator: {op}")
    test = _COMPARISONS[op](ref(name), literal(value, df.schema[name].dataType))
    if op in ("gt", "gte") and isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        # NaN is the largest value to Spark and missing to us. A separate conjunct
        # leaves the comparison itself free to reach the parquet scan.
        test = test & ~F.isnan(ref(name))
    return test


def filter_rows(df: DataFrame, conditions: dict[str, dict[str, Any]]) -> DataFrame:
    """Rows meeting all ``{column: {"op": ..., "value": ...}}`` conditions.

    Names and values are only ever used as names and literals, never as code.
    """
    predicates = [_predicate(df, name, cond["op"], cond["value"]) for name, cond in conditions.items()]
    return df.filter(reduce(lambda a, b: a & b, predicates)) if predicates else df


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    require(df, *columns)
    return df.select(*[ref(c) for c in columns])


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    require(df, *columns)
    return df.drop(*columns)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where every given column is present (neither null nor NaN)."""
    require(df, *columns)
    return df.na.drop(subset=columns)


def picker_values(df: DataFrame, column: str, limit: int = PICKER_VALUES) -> DataFrame:
    """Distinct present values, in the order of their text, for a selection list."""
    require(df, column)
    return (
        complete_rows(df.select(ref(column)), [column])
        .distinct()
        .withColumn("__text", text_of(df, column))
        .orderBy("__text")
        .limit(limit)
        .drop("__text")
    )


def same_table(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same columns and the same rows, duplicates counted."""
    if a.dtypes != b.dtypes:
        return False

    def hashed(df: DataFrame, sign: int) -> DataFrame:
        """Two hashes of each row; hashing skips nulls, so where they are is hashed too."""
        df = missing_as_null(df)
        texts = [text_of(df, c) for c in df.columns]
        places = F.concat(F.lit(""), *[F.when(t.isNull(), "1").otherwise("0") for t in texts])
        return df.select(F.xxhash64(places, *texts).alias("h"), F.xxhash64(F.lit("second"), *texts, places).alias("g"), F.lit(sign).alias("sign"))

    # 16 bytes a row are shuffled, and combined before it.
    counts = hashed(a, 1).unionByName(hashed(b, -1)).groupBy("h", "g").agg(F.sum("sign").alias("more"))
    return counts.filter("more <> 0").isEmpty()
