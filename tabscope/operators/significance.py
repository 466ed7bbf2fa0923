"""Is a difference real? Welch, chi-square, two-proportion and regression tests.

Every test is a few sums over the rows. Only the finished statistic, one row per
test, goes through a vectorised Python function for its tail probability.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.columns import missing_as_null, ref, require
from tabscope.functions.safe import tidy
from tabscope.functions.tails import chi_square_p, normal_p, t_two_sided_p
from tabscope.operators.drift import AFTER, BEFORE, Pair, category_groups, on

DEFAULT_ALPHA = 0.05


def _verdict(p: Column, alpha: float) -> Column:
    return F.coalesce(p < alpha, F.lit(False))


def _moments(value: Column) -> list[Column]:
    """Counts, means and sample variances of both sides; all combine before the shuffle."""
    return [
        F.count(on(BEFORE, value)).alias("n1"),
        F.count(on(AFTER, value)).alias("n2"),
        F.avg(on(BEFORE, value)).alias("m1"),
        F.avg(on(AFTER, value)).alias("m2"),
        F.var_samp(on(BEFORE, value)).alias("v1"),
        F.var_samp(on(AFTER, value)).alias("v2"),
    ]


def numeric_significance(pair: Pair, metric: str, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Welch's t-test of the metric, before against after (unequal variances)."""
    tests = welch(pair.rows.agg(*_moments(pair.number(metric))), alpha)
    return tests.select(F.lit(metric).alias("metric"), "*")


def segment_significance(pair: Pair, metric: str, segment: str, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """The same test within every value of a segment column, one row each.

    Which segment changed for real? Values are told apart by their text; the
    missing ones are a segment named null. A segment on one side only, or with
    a single value on a side, is not applicable; one without any value of the
    metric has no row. Sums combine before the shuffle, so one segment may hold
    most rows and there may be millions of them.
    """
    shared = pair.shared()
    for name in (metric, segment):
        if name not in shared:
            raise KeyError(f"Unknown column: {name}")
    samples = pair.rows.groupBy(pair.text(segment).alias("segment")).agg(*_moments(pair.number(metric)))
    return welch(samples.filter("n1 + n2 > 0"), alpha, ["segment"]).select(F.lit(metric).alias("metric"), F.lit(segment).alias("column"), "*")


def welch(samples: DataFrame, alpha: float = DEFAULT_ALPHA, keys: Sequence[str] = ()) -> DataFrame:
    """The test for every row of counts ``n1 n2``, means ``m1 m2`` and sample variances ``v1 v2``; ``keys`` are kept."""
    c = F.col
    se1, se2 = F.try_divide(c("v1"), c("n1")), F.try_divide(c("v2"), c("n2"))
    spread = F.sqrt(se1 + se2)
    gap = c("m1") - c("m2")
    # Without any variance only a difference of the means says something.
    exact = F.when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf")))
    dof = F.try_divide(
        F.pow(se1 + se2, F.lit(2.0)), F.try_divide(se1 * se1, c("n1") - 1) + F.try_divide(se2 * se2, c("n2") - 1)
    )
    enough = (c("n1") >= 2) & (c("n2") >= 2)
    return (
        samples.withColumn("applicable", enough)
        .withColumn("statistic", F.when(enough, F.when(spread > 0, gap / F.nullif(spread, F.lit(0.0))).otherwise(exact)))
        .withColumn("dof", F.when(enough, F.when(spread > 0, dof).otherwise(F.lit(1.0))))
        .withColumn("p_value", t_two_sided_p("statistic", "dof"))
        .select(
            *[ref(k) for k in keys],
            F.lit("welch_t_test").alias("test"),
            "applicable",
            F.when(~enough, "at least two values are needed on each side").alias("reason"),
            "statistic",
            "p_value",
            F.when(enough, F.lit(alpha)).alias("alpha"),
            F.when(enough, _verdict(F.col("p_value"), alpha)).alias("significant"),
            c("n1").alias("n_before"),
            c("n2").alias("n_after"),
        )
    )


def categorical_significance(pair: Pair, column: str, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Chi-square test of homogeneity of the category counts, continuity-corrected for two categories.

    The side totals are scalar subqueries over the category counts, so no row
    of the counts has to meet all the others.
    """
    counts = category_groups(pair, [column])
    facts = counts.agg(
        F.struct(
            F.coalesce(F.sum("n_before"), F.lit(0)).alias("a"),
            F.coalesce(F.sum("n_after"), F.lit(0)).alias("b"),
            F.count("*").alias("k"),
        ).alias("facts")
    )
    totals = facts.scalar()
    both = F.col("n_before") + F.col("n_after")
    correction = F.when(F.col("t.k") == 2, F.lit(0.5)).otherwise(F.lit(0.0))

    def cell(observed: str, side: str) -> Column:
        expected = F.try_divide(both.cast("double") * F.col(f"t.{side}"), F.col("t.a") + F.col("t.b"))
        gap = F.abs(F.col(observed) - expected)
        gap = gap - F.least(correction, gap)
        return F.try_divide(gap * gap, expected)

    statistic = (
        counts.withColumn("t", totals)
        .agg(F.sum(cell("n_before", "a") + cell("n_after", "b")).alias("chi2"), F.first("t").alias("t"))
        .select("chi2", *[F.coalesce(F.col(f"t.{x}"), F.lit(0)).alias(x) for x in "abk"])
    )
    few, empty = F.col("k") < 2, (F.col("a") == 0) | (F.col("b") == 0)
    usable = ~few & ~empty
    return (
        statistic.withColumn("applicable", usable)
        .withColumn("statistic", F.when(usable, F.col("chi2")))
        .withColumn("dof", F.when(usable, F.col("k") - 1))
        .withColumn("p_value", chi_square_p("statistic", F.col("dof").cast("double")))
        .select(
            F.lit(column).alias("column"),
            F.lit("chi_square").alias("test"),
            "applicable",
            F.when(few, "at least two distinct categories are needed")
            .when(empty, "both sides need values")
            .alias("reason"),
            "statistic",
            "p_value",
            "dof",
            F.when(usable, F.lit(alpha)).alias("alpha"),
            F.when(usable, _verdict(F.col("p_value"), alpha)).alias("significant"),
        )
    )


def conversion_rates(experiments: DataFrame, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Two-proportion z-test for every row of ``count_a total_a count_b total_b``; other columns are kept."""
    c = F.col
    z_limit = NormalDist().inv_cdf(1 - alpha / 2)
    rate_a, rate_b = F.try_divide(c("count_a"), c("total_a")), F.try_divide(c("count_b"), c("total_b"))
    pooled = F.try_divide(c("count_a") + c("count_b"), c("total_a") + c("total_b"))
    inverse = F.try_divide(F.lit(1.0), c("total_a")) + F.try_divide(F.lit(1.0), c("total_b"))
    empty = (c("total_a") <= 0) | (c("total_b") <= 0)
    outside = ~(c("count_a").between(0, c("total_a")) & c("count_b").between(0, c("total_b")))
    se = F.when(~empty & ~outside, F.sqrt(pooled * (1 - pooled) * inverse))
    se_own = F.sqrt(rate_a * (1 - rate_a) / c("total_a") + rate_b * (1 - rate_b) / c("total_b"))
    usable = c("se") > 0
    reason = (
        F.when(empty, "each group needs an observation")
        .when(outside, "counts must lie between 0 and their total")
        .when(c("se") == 0, "the pooled rate does not vary")
    )
    given = [name for name in experiments.columns]
    measured = experiments.withColumn("se", se).withColumn("applicable", F.coalesce(usable, F.lit(False)))
    measured = measured.withColumn("z", F.when(c("applicable"), F.try_divide(rate_b - rate_a, c("se"))))
    measured = measured.withColumn("p", normal_p("z"))
    half = z_limit * se_own
    out = {
        "rate_a": tidy(rate_a, 4),
        "rate_b": tidy(rate_b, 4),
        "diff": tidy(rate_b - rate_a, 4),
        "ci_low": tidy(rate_b - rate_a - half, 4),
        "ci_high": tidy(rate_b - rate_a + half, 4),
        "z": tidy("z", 4),
        "p_value": tidy("p", 6),
        "significant": c("p") < alpha,
    }
    return measured.select(
        *[ref(name) for name in given],
        "applicable",
        reason.alias("reason"),
        *[F.when(c("applicable"), value).alias(name) for name, value in out.items()],
        F.when(c("applicable"), F.lit(alpha)).alias("alpha"),
    )


def conversion_test(
    df: DataFrame, group: str, flag: str, group_a, group_b, alpha: float = DEFAULT_ALPHA
) -> DataFrame:
    """The same from raw rows: rate of a true ``flag`` in two groups of a column."""
    require(df, group, flag)
    g, hit = ref(group), ref(flag).cast("int")
    counts = df.filter(g.isin(group_a, group_b)).agg(
        F.coalesce(F.sum(F.when(g == F.lit(group_a), hit)), F.lit(0)).alias("count_a"),
        F.count(F.when(g == F.lit(group_a), hit)).alias("total_a"),
        F.coalesce(F.sum(F.when(g == F.lit(group_b), hit)), F.lit(0)).alias("count_b"),
        F.count(F.when(g == F.lit(group_b), hit)).alias("total_b"),
    )
    return conversion_rates(counts, alpha)


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line over complete pairs, with the p-value of its slope."""
    require(df, x, y)
    xy = missing_as_null(df.select(ref(x).cast("double").alias("x"), ref(y).cast("double").alias("y"))).na.drop()
    vx, vy = F.col("x"), F.col("y")
    fit = xy.agg(
        F.count("*").alias("n"),
        F.regr_slope(vy, vx).alias("slope"),
        F.regr_intercept(vy, vx).alias("intercept"),
        F.regr_r2(vy, vx).alias("r2"),
        F.min(vx).alias("x_min"),
        F.max(vx).alias("x_max"),
        F.max(vy).alias("y_max"),
        F.min(vy).alias("y_min"),
    )
    c = F.col
    usable = F.coalesce((c("n") >= 2) & (c("x_max") > c("x_min")), F.lit(False))
    flat = c("y_max") == c("y_min")
    r2 = F.when(flat, F.lit(0.0)).otherwise(c("r2"))
    # An exact fit leaves nothing unexplained: the statistic is infinite.
    t = F.when(c("r2") >= 1.0, F.lit(float("inf"))).otherwise(
        F.sqrt(c("r2") * F.try_divide((c("n") - 2).cast("double"), 1.0 - c("r2")))
    )
    return (
        fit.withColumn("applicable", usable)
        .withColumn("r2", F.when(usable, r2))
        .withColumn("t", F.when(usable & (c("n") > 2), t))
        .withColumn("dof", (c("n") - 2).cast("double"))
        .withColumn("p", t_two_sided_p("t", "dof"))
        .select(
            "applicable",
            F.when(~usable, "two complete pairs and a varying x are needed").alias("reason"),
            "n",
            F.when(usable, c("slope")).alias("slope"),
            F.when(usable, c("intercept")).alias("intercept"),
            "r2",
            F.when(usable, F.when(c("n") == 2, F.when(flat, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(c("p"))).alias(
                "p_value"
            ),
            "x_min",
            "x_max",
        )
    )


def any_significant(*tests: DataFrame) -> DataFrame:
    """One row: whether any of the given tests found something."""
    flags = [t.select(F.coalesce("significant", F.lit(False)).alias("significant")) for t in tests]
    rows = flags[0]
    for flag in flags[1:]:
        rows = rows.unionByName(flag)
    return rows.agg(F.coalesce(F.bool_or("significant"), F.lit(False)).alias("significant"))
