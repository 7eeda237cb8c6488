"""Correlated, year-over-year, window and drill queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def above_group_average(rows: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Rows whose measure is above the average of their own group.

    The averages are one small row a group, joined back: rows are neither shuffled nor sorted by group, so that a group with
    most of the rows costs no more than any other.
    """
    averages = rows.groupBy(*by).agg(F.avg(measure).alias("_avg"))
    named = averages.select(*[F.col(c).alias(f"_{c}") for c in by], "_avg")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return rows.join(named, on).filter(F.col(measure) > F.col("_avg")).drop("_avg", *[f"_{c}" for c in by])


def above_reference_average(rows: DataFrame, reference: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Rows whose measure is above the average of the same group in ``reference``; a group that is missing there drops its rows."""
    averages = reference.groupBy(*by).agg(F.avg(measure).alias("_avg"))
    return rows.join(averages, by).filter(F.col(measure) > F.col("_avg")).drop("_avg")


def growth(rows: DataFrame, by: list[str], measure: str, period: str, now: int, before: int, over: tuple[int, int] = (1, 1)) -> DataFrame:
    """Groups of period ``now`` with sum(now) * over[0] > sum(before) * over[1], and the difference d; groups of ``before`` alone are left out.

    Both sums come from one aggregation, not from a join of two.
    """
    p = F.col(period)
    sums = rows.filter(p.isin(now, before)).groupBy(*by).agg(
        F.sum(F.when(p == now, F.col(measure))).alias("_now"), F.coalesce(F.sum(F.when(p == before, F.col(measure))), F.lit(0)).alias("_before"))
    return sums.filter(F.col("_now") * over[0] > F.col("_before") * over[1]).select(*by, (F.col("_now") - F.col("_before")).cast("long").alias("d"))


def moving_windows(rows: DataFrame, step: str, measure: str, width: int, last_start: int) -> DataFrame:
    """For each start m0 from the steps that occur up to ``last_start``: n and sp over steps m0 to m0 + width - 1.

    Each step's own sums are expanded into the windows that hold it, so the rows are read and reduced once.
    """
    sums = rows.groupBy(step).agg(F.count("*").alias("n"), F.sum(measure).alias("sp"))
    starts = sums.filter(F.col(step) <= last_start).select(F.col(step).alias("m0"))
    wide = sums.select(F.explode(F.sequence(F.col(step) - (width - 1), F.col(step))).alias("m0"), "n", "sp")
    return wide.join(starts, "m0", "left_semi").groupBy("m0").agg(F.sum("n").alias("n"), F.sum("sp").cast("long").alias("sp"))


def centred_windows(rows: DataFrame, step: str, measure: str, reach: int = 1) -> DataFrame:
    """For each step the sums of the steps up to ``reach`` before and after it (by value)."""
    sums = rows.groupBy(step).agg(F.count("*").alias("n"), F.sum(measure).cast("long").alias("sp"))
    around = Window.orderBy(step).rangeBetween(-reach, reach)  # one row a step
    return sums.select(step, F.sum("n").over(around).alias("n"), F.sum("sp").over(around).alias("sp"))


def drill(rows: DataFrame, wanted: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows that equal a drill's values, once for each drill given; ``on``: column of rows -> column of wanted."""
    # equal drills are counted instead of joined one by one
    drills = wanted.groupBy(*on.values()).agg(F.count("*").alias("_times"))
    cond = [F.col(a) == F.col(b) for a, b in on.items()]
    return rows.join(drills, cond).drop(*on.values())
