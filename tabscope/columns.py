"""Type classes of columns, and what can be decided from a schema alone."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(dtype: T.DataType, with_bool: bool = False) -> bool:
    return isinstance(dtype, T.NumericType) or (with_bool and isinstance(dtype, T.BooleanType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def ref(name: str) -> Column:
    """A column by its exact name; dots and backticks in it are taken literally."""
    return F.col("`" + name.replace("`", "``") + "`")


def comparable(value: Any, dtype: T.DataType) -> bool:
    """Whether a constant and a column have values of one kind; Spark would cast one of them or fail."""
    if isinstance(value, bool):
        return is_numeric(dtype, with_bool=True)
    if isinstance(value, (int, float, Decimal)):
        return is_numeric(dtype) or (isinstance(dtype, T.BooleanType) and value in (0, 1))
    if isinstance(value, date):
        return is_datetime(dtype)
    return isinstance(value, str) and (is_text(dtype) or is_datetime(dtype))


def literal(value: Any, dtype: T.DataType) -> Column:
    """A constant of a comparable kind to compare a column with.

    Dates take the type of the column: otherwise Spark would cast the column,
    and the comparison could no longer be answered from file statistics. Text
    that is no date is null, which equals nothing.
    """
    if not comparable(value, dtype):
        raise TypeError(f"cannot order {dtype.simpleString()} values against {value!r}")
    if is_datetime(dtype):
        return F.lit(str(value)).try_cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lit(bool(value))
    return F.lit(int(value) if isinstance(value, bool) else value)


def equals(df: DataFrame, name: str, value: Any) -> Column:
    """Whether a column has this value; a value of another kind is in no row."""
    dtype = df.schema[name].dataType
    return ref(name) == literal(value, dtype) if comparable(value, dtype) else F.lit(False)


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise KeyError(f"Unknown column: {name}")


def numeric_columns(df: DataFrame, with_bool: bool = False) -> list[str]:
    """Number columns. Sums and means of snapshots also count booleans (``with_bool``)."""
    return [f.name for f in df.schema if is_numeric(f.dataType, with_bool)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Text columns and nested columns."""
    return [f.name for f in df.schema if is_text(f.dataType) or is_nested(f.dataType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_datetime(f.dataType)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]


def nested_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_nested(f.dataType)]


def missing_as_null(df: DataFrame) -> DataFrame:
    """Read NaN in floating-point columns as null, the one notion of "missing" here."""
    if not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema):
        return df
    return df.select(
        *[
            F.nanvl(ref(f.name), F.lit(None)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else ref(f.name)
            for f in df.schema
        ]
    )


def as_text(column: Column, dtype: T.DataType) -> Column:
    """String form of a value; nested values compare by their JSON text."""
    if isinstance(dtype, T.VariantType) or is_nested(dtype):
        return F.to_json(column)
    return column.cast("string")


def text_of(df: DataFrame, name: str) -> Column:
    return as_text(ref(name), df.schema[name].dataType)


def select_by_class(df: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """Keep the columns of the given classes: numeric, categorical, datetime, boolean."""
    pickers = {
        "numeric": numeric_columns,
        "categorical": categorical_columns,
        "datetime": datetime_columns,
        "boolean": boolean_columns,
    }
    keep = {name for kind in kinds for name in pickers[kind](df)}
    return df.select(*[ref(c) for c in df.columns if c in keep])


def unused_name(wanted: str, taken: Iterable[str]) -> str:
    taken = set(taken)
    while wanted in taken:
        wanted = "_" + wanted
    return wanted


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of few rows that the driver knows; it becomes a literal relation in the plan."""
    names = T.StructType.fromDDL(schema).names
    return spark.createDataFrame(pd.DataFrame(rows, columns=names, dtype=object), schema)


def rows_of(one_row: DataFrame, records: list[list[Column]], names: list[str]) -> DataFrame:
    """Turn a one-row aggregate into one row per record.

    ``records`` holds, for each wanted row, its column expressions in the order of ``names``.
    """
    structs = [F.struct(*[c.alias(n) for c, n in zip(record, names)]) for record in records]
    return one_row.select(F.inline(F.array(*structs)))


def long_texts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value) rows of text columns, missing values included.

    Tests that differ only in the column then are a handful of aggregates by
    column, whatever the number of columns, and stay small enough to compile.
    """
    return df.select(*[ref(c) for c in names]).unpivot([], [ref(c) for c in names], "column", "value")


def position_in(names: list[str], column: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in names]), column) - 1).cast("int")
