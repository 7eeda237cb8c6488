"""Aggregations over cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aggregate_dim(rows: DataFrame, dim: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """One row (n, s, a): COUNT, SUM and AVG of a dimension's codes, over a closed key range if given. No rows: 0, 0 and NULL."""
    if low is not None:
        rows = rows.filter(F.col("key") >= low)
    if high is not None:
        rows = rows.filter(F.col("key") <= high)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(dim), F.lit(0)).cast("long").alias("s"), F.avg(dim).alias("a"))


def group_sum(rows: DataFrame, by: list[str], measure: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(measure).cast("long").alias("sp"))


def group_count(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def having_above(rows: DataFrame, by: str, measure: str, threshold: int) -> DataFrame:
    """Groups whose sum is above a fixed threshold."""
    return rows.groupBy(by).agg(F.sum(measure).cast("long").alias("sp")).filter(F.col("sp") > threshold)


def having_above_share(rows: DataFrame, by: str, measure: str, parts: int) -> DataFrame:
    """Groups whose sum is above one of ``parts`` equal shares of the total. The total is summed from the groups, not the rows."""
    groups = rows.groupBy(by).agg(F.sum(measure).cast("long").alias("sp"))
    total = groups.agg(F.sum("sp").alias("total"))
    return groups.join(F.broadcast(total), F.col("sp") * parts > F.col("total")).select(by, "sp")  # total: one row


def rollup_two(rows: DataFrame, outer: str, inner: str, measure: str) -> DataFrame:
    """Sums by (outer, inner) and by outer, without a grand total."""
    fine = rows.groupBy(outer, inner).agg(F.count("*").alias("n"), F.sum(measure).cast("long").alias("sp"))
    # the coarse sums come from the fine ones: rows are expanded once a group, not once a row
    return fine.groupingSets([[outer, inner], [outer]], outer, inner).agg(F.sum("n").alias("n"), F.sum("sp").alias("sp"))


def top_groups(rows: DataFrame, by: str, measure: str, k: int) -> DataFrame:
    """The k groups of greatest sum; ties to the smaller group."""
    return rows.groupBy(by).agg(F.sum(measure).cast("long").alias("sp")).orderBy(F.desc("sp"), by).limit(k)


def top_per(rows: DataFrame, part: str, by: str, measure: str, k: int) -> DataFrame:
    """For each ``part`` the k groups of greatest sum; ties to the smaller group."""
    sums = rows.groupBy(part, by).agg(F.sum(measure).cast("long").alias("sp"))
    best = Window.partitionBy(part).orderBy(F.desc("sp"), by)
    return sums.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).drop("rn")


def distinct_codes(rows: DataFrame, dims: list[str]) -> DataFrame:
    """One row: exact distinct counts."""
    return rows.agg(*[F.count_distinct(d).alias(f"d_{d}") for d in dims])
