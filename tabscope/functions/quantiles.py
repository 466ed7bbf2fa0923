"""Exact quantiles in bounded memory.

The built-in exact ``percentile`` keeps every distinct value of the column in
one task. That is right for a few million values and impossible for 10**12. So
larger columns are first narrowed: a mergeable sketch (``percentile_approx``)
gives two values around the wanted rank, a counting pass says how many rows lie
below, at, between and above them, and this repeats between the two until what
is left is small enough for ``percentile``. Each round shrinks the search by a
factor of about a thousand, reads only the columns concerned and shuffles only
sketches; the result is the exact interpolated quantile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.columns import ref

# Values the exact `percentile` buffers of one task may hold together (about 50 bytes each).
BUFFER_ROWS = 2_000_000
_SKETCH_ACCURACY = 10_000


@dataclass(frozen=True)
class _Search:
    """The value of zero-based ``rank``: one of the ``inside`` values strictly between the bounds."""

    value: Column
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    answer: float | None = None

    def candidates(self) -> Column:
        test = self.value.isNotNull()
        if self.low is not None:
            test = test & (self.value > F.lit(self.low))
        if self.high is not None:
            test = test & (self.value < F.lit(self.high))
        return F.when(test, self.value)

    def sketch(self) -> Column:
        at = (self.rank - self.below + 0.5) / self.inside
        margin = 2.0 / _SKETCH_ACCURACY
        ends = [max(0.0, at - margin), min(1.0, at + margin)]
        return F.percentile_approx(self.candidates(), F.array(*[F.lit(p) for p in ends]), _SKETCH_ACCURACY)

    def counts(self, low: float, high: float) -> Column:
        v, a, b = self.value, F.lit(low), F.lit(high)
        return F.array(
            F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v < b)), F.count_if((v == b) & (b > a))
        )

    def narrowed(self, low: float, high: float, counts: list[int]) -> _Search:
        below, at_low, between, at_high = counts
        if self.rank < below:
            return replace(self, high=low, inside=below - self.below)
        if self.rank < below + at_low:
            return replace(self, answer=low)
        if self.rank < below + at_low + between:
            return replace(self, low=low, high=high, below=below + at_low, inside=between)
        passed = below + at_low + between + at_high
        if self.rank < passed:
            return replace(self, answer=high)
        return replace(self, low=high, below=passed, inside=self.below + self.inside - passed)


def _batches(sizes: dict, limit: int) -> Iterator[list]:
    """Cut the keys into groups whose sizes add up to no more than ``limit`` (or that are alone)."""
    batch, total = [], 0
    for key, size in sizes.items():
        if batch and total + size > limit:
            yield batch
            batch, total = [], 0
        batch.append(key)
        total += size
    if batch:
        yield batch


def values_at(
    df: DataFrame, wanted: list[tuple[Column, int, int]], buffer_rows: int = BUFFER_ROWS
) -> list[float | None]:
    """For each (expression, zero-based rank, number of non-null values): the value of that rank."""
    searches = [_Search(v.cast("double"), rank, count) for v, rank, count in wanted]
    while True:
        large = [i for i, s in enumerate(searches) if s.answer is None and s.inside > buffer_rows]
        if not large:
            break
        sketched = df.agg(*[searches[i].sketch().alias(f"s{i}") for i in large]).first()
        counted = df.agg(*[searches[i].counts(*sketched[f"s{i}"]).alias(f"c{i}") for i in large]).first()
        for i in large:
            searches[i] = searches[i].narrowed(*sketched[f"s{i}"], counted[f"c{i}"])

    small = [i for i, s in enumerate(searches) if s.answer is None and s.inside > 0]
    if small:
        # The ranks of one column share one buffer: ask for them in one array.
        groups: dict[tuple, list[int]] = {}
        for i in small:
            s = searches[i]
            groups.setdefault((str(s.value), s.below, s.low, s.high), []).append(i)
        inside = {g: searches[members[0]].inside for g, members in enumerate(groups.values())}
        members_of = dict(enumerate(groups.values()))
        for batch in _batches(inside, buffer_rows):
            exprs = []
            for g in batch:
                s = searches[members_of[g][0]]
                steps = max(s.inside - 1, 1)
                parts = F.array(*[F.lit((searches[i].rank - s.below) / steps) for i in members_of[g]])
                exprs.append(F.percentile(s.candidates(), parts).alias(f"g{g}"))
            row = df.agg(*exprs).first()
            for g in batch:
                for i, answer in zip(members_of[g], row[f"g{g}"]):
                    searches[i] = replace(searches[i], answer=answer)
    return [s.answer for s in searches]


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column] | list[str],
    probabilities: list[float],
    counts: dict[str, int] | None = None,
    buffer_rows: int = BUFFER_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; ``[None, ...]`` for a column without values.

    ``counts`` are the numbers of non-null values, if the caller has them already.
    """
    if not isinstance(values, dict):
        values = {name: ref(name) for name in values}
    if not values:
        return {}
    values = {name: value.cast("double") for name, value in values.items()}
    if counts is None:
        row = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())]).first()
        counts = {name: row[f"n{i}"] for i, name in enumerate(values)}

    if max(counts[name] for name in values) <= buffer_rows:
        points = F.array(*[F.lit(float(p)) for p in probabilities])
        found: dict[str, list[float | None]] = {}
        for batch in _batches({name: counts[name] for name in values}, buffer_rows):
            row = df.agg(*[F.percentile(values[name], points).alias(f"q{i}") for i, name in enumerate(batch)]).first()
            found |= {name: row[f"q{i}"] or [None] * len(probabilities) for i, name in enumerate(batch)}
        return found

    wanted, places = [], []
    for name, value in values.items():
        for p in probabilities:
            if counts[name]:
                at = p * (counts[name] - 1)
                wanted += [(value, math.floor(at), counts[name]), (value, math.ceil(at), counts[name])]
                places.append((name, at - math.floor(at)))
    answers = values_at(df, wanted, buffer_rows)
    result: dict[str, list[float | None]] = {name: [] for name in values}
    for i, (name, fraction) in enumerate(places):
        low, high = answers[2 * i], answers[2 * i + 1]
        result[name].append(low if low == high else low + (high - low) * fraction)
    return {name: found or [None] * len(probabilities) for name, found in result.items()}
