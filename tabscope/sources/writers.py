"""Exports, samples, previews and the model store."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.columns import is_numeric, ref
from tabscope.functions.quantiles import BUFFER_ROWS, values_at
from tabscope.operators.importance import Scorer

EXPORT_CAP = 20_000
SAMPLE_CAP = 5_000
PREVIEW_ROWS = 50


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """Write each table of a report as JSON rows under ``path``."""
    for name, table in report.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def capped_export(df: DataFrame, order_by: list[str], cap: int = EXPORT_CAP) -> DataFrame:
    """The first ``cap`` rows in key order, each marked with whether the table has more."""
    total = df.count()
    rows = df
    if total > cap:
        lead = ref(order_by[0])
        if total > BUFFER_ROWS and is_numeric(df.schema[order_by[0]].dataType):
            # Every task would hand `cap` rows to the final top-n. Dropping what lies
            # beyond the cap-th key first leaves it little more than `cap` rows in all.
            present = df.agg(F.count(lead)).first()[0]
            if present > cap:
                (cut,) = values_at(df, [(lead, cap - 1, present)])
                rows = df.filter(lead.isNull() | (lead.cast("double") <= F.lit(cut)))
        rows = rows.orderBy(*[ref(c) for c in order_by]).limit(cap)
    return rows.withColumn("truncated", F.lit(total > cap))


def sample_rows(df: DataFrame, key: list[str], n: int = SAMPLE_CAP, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are no more), the same ones on every run.

    Rows are ranked by a hash of their key. As hashes are uniform, the ``n``
    smallest lie under a threshold known from the row count; rows above it are
    dropped in the scan, so that the final top-n sees little more than ``n`` rows.
    """
    total = df.count()
    if total <= n:
        return df
    hashed = F.xxhash64(*[ref(c) for c in key], F.lit(seed))
    expected = n + 10 * math.sqrt(n) + 100
    if expected < total:
        below = df.filter(hashed <= F.lit(int(-(2**63) + expected / total * 2**64)))
        if below.count() >= n:
            df = below
    return df.orderBy(hashed, *[ref(c) for c in key]).limit(n)


def schema_summary(df: DataFrame) -> DataFrame:
    """Column names and types, with the row and column counts beside them."""
    types = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return df.agg(F.count("*").alias("n_rows")).select(
        F.inline(types), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns")
    )


def preview(df: DataFrame, order_by: list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(*[ref(c) for c in order_by]).limit(n)


def save_model(model: Scorer, path: str) -> None:
    """Everything needed to score raw rows, as one folder."""
    model.save(path)


def load_model(spark: SparkSession, path: str) -> Scorer:
    return Scorer.load(spark, path)
