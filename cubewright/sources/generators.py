"""Synthetic sales rows in four distributions, made in parallel from row numbers and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import sales_schema

DISTRIBUTIONS = ("uniform", "clustered", "skewed", "sequential")


def _whole(low: int, high: int, seed: int) -> Column:
    """A whole number from low to high, both included."""
    return F.floor(F.rand(seed) * (high - low + 1) + low).cast("long")


def _normal(mean: float, spread: float, seed: int) -> Column:
    return F.greatest(F.lit(100), F.floor(F.randn(seed) * spread + mean)).cast("long")


def generate(spark: SparkSession, distribution: str, n: int, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """n rows of codes (year, month, day, state, product, price, version), value (the row's number) and key.

    Codes are 0-based: month 5 is June. The numbers of the four distributions are fixed values.
    """
    schema = sales_schema()
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    i = F.col("id")
    states, products = [schema.dim(d).labels for d in ("state", "product")]
    any_date = {"year": _whole(20, 24, seed), "month": _whole(0, 11, seed + 1), "day": _whole(0, 27, seed + 2)}
    base = any_date | {"state": _whole(0, len(states) - 1, seed + 3), "product": _whole(0, len(products) - 1, seed + 4), "price": _whole(500, 200_000, seed + 5), "version": _whole(100, 500, seed + 6)}
    if distribution == "uniform":
        cols = base
    elif distribution == "clustered":
        pick = F.floor(F.rand(seed + 7) * 3)
        centres = [("CA", "Laptop", 20, 120_000, 40_000), ("NY", "Mouse", 21, 3_500, 1_000), ("TX", "Keyboard", 22, 8_000, 2_500)]
        by = lambda f: F.element_at(F.array(*[f(k, c) for k, c in enumerate(centres)]), pick.cast("int") + 1)
        cols = base | {
            "state": by(lambda k, c: F.lit(states.index(c[0])).cast("long")), "product": by(lambda k, c: F.lit(products.index(c[1])).cast("long")),
            "year": by(lambda k, c: _whole(c[2], c[2] + 2, seed + 10 + k)), "price": by(lambda k, c: _normal(c[3], c[4], seed + 20 + k))}
    elif distribution == "skewed":
        hot = i < F.lit(n * 8 // 10)
        fixed = {"year": F.lit(22), "month": F.lit(5), "state": F.lit(states.index("CA")), "product": F.lit(products.index("Laptop")), "price": _whole(90_000, 150_000, seed + 8)}
        cols = base | {d: F.when(hot, c.cast("long")).otherwise(base[d]) for d, c in fixed.items()}
    elif distribution == "sequential":
        day = i % (255 * 12 * 28)
        cols = {
            "year": F.floor(day / (12 * 28)), "month": F.floor(day / 28) % 12, "day": day % 28, "state": F.floor(i / 100) % len(states),
            "product": F.floor(i / 50) % len(products), "price": 50_000 + i % 100_000, "version": 100 + i % 400}
    else:
        raise ValueError(f"unknown distribution {distribution}")
    rows = rows.select(*[cols[d].cast("long").alias(d) for d in schema.names], i.alias("value"))
    return rows.withColumn("key", schema.key())
