"""Scans, cursors and point lookups by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def ordered(rows: DataFrame, descending: bool = False) -> DataFrame:
    """All rows in key order (ties by value)."""
    return rows.orderBy(F.desc("key"), F.desc("value")) if descending else rows.orderBy("key", "value")


def lower_bound(rows: DataFrame, key: int) -> DataFrame:
    """Rows from the first key not below ``key`` on, in key order."""
    return ordered(rows.filter(F.col("key") >= key))


def upper_bound(rows: DataFrame, key: int) -> DataFrame:
    """Rows from the first key above ``key`` on, in key order."""
    return ordered(rows.filter(F.col("key") > key))


def range_search(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Rows of keys in the closed range; none if low > high."""
    return rows.filter(F.col("key").between(low, high))


def point(rows: DataFrame, key: int) -> DataFrame:
    """All rows of one key."""
    return rows.filter(F.col("key") == key)


def point_lookup(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """All rows of each probe key (column pk); a probe given twice finds its rows twice."""
    return rows.join(keys, F.col("key") == F.col("pk")).drop("pk")


def cursor(rows: DataFrame, low: int | None = None, high: int | None = None) -> Iterator[Row]:
    """Rows in key order, a partition at a time on the driver."""
    if low is not None:
        rows = rows.filter(F.col("key") >= low)
    if high is not None:
        rows = rows.filter(F.col("key") <= high)
    return ordered(rows).toLocalIterator(prefetchPartitions=True)


def visit(rows: DataFrame, callback: Callable[[Iterator[Row]], None]) -> None:
    """Call back with the rows of each partition, on the executors."""
    rows.select("key", "value").foreachPartition(callback)


def checksum(rows: DataFrame, *sums: str) -> DataFrame:
    """One row: n, the sums asked for (as s_<column>) and the XOR of keys."""
    return rows.agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(f"s_{c}") for c in sums], F.bit_xor("key").alias("chk"))
