"""Counts, sums, spreads and extremes of very many columns in one pass.

An aggregate per column and figure makes generated code that grows with the
width of the table until it is slower than the data. Here all columns travel
together as numbers, each task keeps a handful of arrays as long as the table
is wide, and one row per column and task is merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers worked on at once: some megabytes.
CELLS_AT_ONCE = 1 << 18
_FIGURES = "side int, i int, rows bigint, n bigint, total double, squares double, low double, high double"


@dataclass(frozen=True)
class Moments:
    """What is known of one column: rows, present values, their sum, squares about their mean, extremes."""

    rows: int
    n: int
    total: float
    squares: float
    low: float | None
    high: float | None

    @property
    def mean(self) -> float | None:
        return self.total / self.n if self.n else None

    @property
    def std(self) -> float | None:
        """Of a sample; a single value has none."""
        return (self.squares / (self.n - 1)) ** 0.5 if self.n > 1 else None


def partial_moments(df: DataFrame, values: dict[str, Column], side: Column | None = None) -> DataFrame:
    """Figures of each task, (side, column number) by row; ``side`` is a number from 0 on, null is missing and NaN too."""
    width = len(values)

    def add(held: dict[int, list[np.ndarray]], parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        x, sides = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
        for s in np.unique(sides).tolist():
            own = x if (sides == s).all() else x[:, sides == s]
            n, total = np.count_nonzero(~np.isnan(own), axis=1), np.nansum(own, axis=1)
            mean = total / np.maximum(n, 1)
            squares = np.nansum((own - mean[:, None]) ** 2, axis=1)
            found = [np.full(width, own.shape[1]), n, total, squares, np.fmin.reduce(own, axis=1), np.fmax.reduce(own, axis=1)]
            held[s] = found if s not in held else _merged(held[s], found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        cells = 0
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                x = np.array([batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)], dtype=float)
                parts.append((x, batch.column(width).to_numpy(zero_copy_only=False)))
                cells += x.size
                if cells >= CELLS_AT_ONCE:
                    add(held, parts)
                    parts, cells = [], 0
            if parts:
                add(held, parts)
            for s, (rows, n, total, squares, low, high) in held.items():
                arrays = [pa.array(np.full(width, s), pa.int32()), pa.array(np.arange(width), pa.int32()), pa.array(rows, pa.int64()), pa.array(n, pa.int64())]
                arrays += [pa.array(v, pa.float64()) for v in (total, squares)] + [pa.array(v, pa.float64(), mask=n == 0) for v in (low, high)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _FIGURES.split(", ")])

    columns = [value.cast("double").alias(f"v{i}") for i, value in enumerate(values.values())]
    return df.select(*columns, (F.lit(0) if side is None else side).cast("int").alias("side")).mapInArrow(run, _FIGURES)


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Figures of two sets of rows together; squares about a new mean grow by the distance of the old ones."""
    n, total = a[1] + b[1], a[2] + b[2]
    gap = b[2] / np.maximum(b[1], 1) - a[2] / np.maximum(a[1], 1)
    between = np.where((a[1] > 0) & (b[1] > 0), gap * gap * a[1] * b[1] / np.maximum(n, 1), 0.0)
    return [a[0] + b[0], n, total, a[3] + b[3] + between, np.fmin(a[4], b[4]), np.fmax(a[5], b[5])]


def moments(df: DataFrame, values: dict[str, Column], side: Column | None = None) -> dict[tuple[int, str], Moments]:
    """(side, name) -> figures, for sides that have rows. One row per side and column reaches the driver."""
    names = list(values)
    if not names:
        return {}
    c = F.col
    parts = partial_moments(df, values, side)
    # Squares about the overall mean: each task's own, and its mean's distance, summed about a value near both.
    part = F.struct("rows", "n", "total", "squares", "low", "high")
    merged = parts.groupBy("side", "i").agg(F.collect_list(part).alias("parts"))  # one short entry per task
    n, total = (F.aggregate(c("parts")[f], F.lit(0).cast(t), lambda a, x: a + x) for f, t in (("n", "bigint"), ("total", "double")))
    merged = merged.withColumn("n", n).withColumn("total", total).withColumn("mean", F.try_divide(c("total"), c("n")))
    distance = F.aggregate(
        "parts",
        F.lit(0.0),
        lambda a, p: a + p["squares"] + F.when(p["n"] > 0, p["n"] * F.pow(p["total"] / p["n"] - c("mean"), F.lit(2.0))).otherwise(0.0),
    )
    rows = F.aggregate(c("parts")["rows"], F.lit(0).cast("bigint"), lambda a, x: a + x)
    found = merged.select("side", "i", rows.alias("rows"), "n", "total", distance.alias("squares"), F.array_min(c("parts")["low"]).alias("low"), F.array_max(c("parts")["high"]).alias("high"))
    return {(r["side"], names[r["i"]]): Moments(r["rows"], r["n"], r["total"], r["squares"], r["low"], r["high"]) for r in found.collect()}
