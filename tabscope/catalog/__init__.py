"""The registered queries: one or more per operator, each with its check in plain SQL.

A query gets :class:`Tables` and returns a DataFrame. Where both sides need the
same derived columns, they are written once as SQL expressions that Spark and
the checking engine both understand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tabscope.session import tune

MODULES = ("selection", "joining", "describing", "changes", "testing", "repairing", "growth", "models")


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derived(self, view: Derived) -> DataFrame:
        return getattr(self, view.table).selectExpr(*view.expressions)


@dataclass(frozen=True)
class Derived:
    """Columns derived from one table, in SQL both engines read alike."""

    table: str
    expressions: tuple[str, ...]

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self.expressions)} FROM {self.table})"


REGISTRY: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its check, None where SQL cannot say it."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = (build, sql)
        return build

    return register


def rounded(expression: str, digits: int) -> str:
    """Half-up rounding of the decimal value, once, with the same guard as ``tidy``."""
    return f"CAST(round(CAST(({expression}) * (1 + 1e-12) AS DECIMAL(38, 15)), {digits}) AS DOUBLE)"


def load_all() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    for module in MODULES:
        import_module(f"tabscope.catalog.{module}")
    return REGISTRY


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build):
        return lambda spark, sf_dir: build(Tables(tune(spark), str(sf_dir).rstrip("/")))

    return {name: runner(build) for name, (build, _) in load_all().items()}


def check_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in load_all().items() if sql is not None}


# ── derived tables several queries share ─────────────────────────────────────

ORDERS_GAPS = Derived(
    "orders",
    (
        "o_orderkey",
        "o_custkey",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority",
        "o_orderstatus",
        "o_orderdate",
        "o_orderkey % 3 = 0 AS flagged",
    ),
)

EVENTS_GAPS = Derived(
    "events",
    (
        "event_id",
        "user_id",
        "ts",
        "event_type",
        "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 97 = 0 THEN value * 50 ELSE value END AS value",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS label",
    ),
)

LINES_BY_YEAR = ("l_shipdate", ("1996-01-01", "1996-12-31 23:59:59"), ("1997-01-01", "1997-12-31 23:59:59"))
ORDERS_BY_YEAR = ("o_orderdate", ("1996-01-01", "1996-12-31 23:59:59"), ("1997-01-01", "1997-12-31 23:59:59"))


def sided(table: str, column: str, before: tuple, after: tuple) -> str:
    """The rows of two ranges with their ``side``, a row in both ranges twice."""
    return (
        f"(SELECT *, 'before' AS side FROM {table} WHERE {column} BETWEEN '{before[0]}' AND '{before[1]}'"
        f" UNION ALL SELECT *, 'after' AS side FROM {table} WHERE {column} BETWEEN '{after[0]}' AND '{after[1]}')"
    )
