"""Retention of users by the period of their first activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.columns import missing_as_null, ref, require
from tabscope.functions.dates import day_rows, period_label, period_start, periods_between
from tabscope.functions.safe import tidy
from tabscope.session import cut_lineage

MIN_USERS = 2
MIN_COHORTS = 2
PERIODS = ("D", "W", "M")


def _active_users(df: DataFrame, user: str, date: str, period: str) -> DataFrame:
    """(cohort, period_offset, active): how many users of a cohort were active so many periods later.

    A user is one set of active periods, no larger than the calendar, merged
    in every task before the one shuffle by user; so a user with a third of all
    events is one short row there. Cohort and offsets are read from the set, and
    the counts combine before they meet.
    """
    events = missing_as_null(day_rows(df, date, user=ref(user))).na.drop()
    users = events.groupBy("user").agg(F.collect_set(period_start(F.col("day"), period)).alias("periods"))
    visits = users.select(F.array_min("periods").alias("cohort"), F.explode("periods").alias("period"))
    offset = periods_between(F.col("cohort"), F.col("period"), period).alias("period_offset")
    return visits.groupBy("cohort", offset).agg(F.count("*").alias("active"))


def compute_retention(df: DataFrame, user: str, date: str, period: str = "M", min_cohorts: int = MIN_COHORTS) -> DataFrame:
    """Rows ``(applicable, reason, cohort, period_offset, active, cohort_size, retention)``.

    Every user is active in the period that makes it a member, so the size of a
    cohort is its active count at offset 0. One row with ``applicable`` false
    stands for too few users or cohorts; ``min_cohorts=1`` also shows the curve
    of a single cohort.
    """
    if period not in PERIODS:
        raise ValueError(f"Unknown period: {period}")
    require(df, user, date)
    active = _active_users(df, user, date, period)
    facts = (
        active.filter("period_offset = 0")
        .agg(F.coalesce(F.sum("active"), F.lit(0)).alias("users"), F.count("*").alias("cohorts"))
        .select(
            F.when(F.col("users") < MIN_USERS, f"at least {MIN_USERS} users with valid dates are needed")
            .when(F.col("cohorts") < min_cohorts, f"at least {min_cohorts} distinct {period}-periods are needed")
            .alias("reason")
        )
    )
    reason = facts.scalar()
    size = F.max(F.when(F.col("period_offset") == 0, F.col("active"))).over(Window.partitionBy("cohort"))
    rows = (
        active.withColumn("cohort_size", size)
        .filter(reason.isNull())
        .select(
            F.lit(True).alias("applicable"),
            F.lit(None).cast("string").alias("reason"),
            period_label(F.col("cohort"), period).alias("cohort"),
            "period_offset",
            "active",
            "cohort_size",
            tidy(F.col("active") / F.col("cohort_size"), 4).alias("retention"),
        )
    )
    refusal = facts.filter("reason is not null").select(F.lit(False).alias("applicable"), "reason")
    return rows.unionByName(refusal, allowMissingColumns=True)


def retention_matrix(retention: DataFrame) -> DataFrame:
    """Cohorts as rows, the offsets that occur as columns ``offset_0, offset_1, ...``; unseen is null.

    The events are read once: the rows, one per cohort and offset, are stored
    before the offsets among them are listed, and one aggregate turns them.
    """
    rows = cut_lineage(retention.filter("applicable").select("cohort", "cohort_size", "period_offset", "retention"))
    offsets = [r[0] for r in rows.select("period_offset").distinct().orderBy("period_offset").collect()]
    turned = rows.groupBy("cohort", "cohort_size").pivot("period_offset", offsets or [0]).agg(F.max("retention"))
    return turned.select("cohort", "cohort_size", *[ref(str(n)).alias(f"offset_{n}") for n in offsets]).orderBy("cohort")
