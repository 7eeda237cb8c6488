"""Statistics of stored cubes: summaries, histograms, homogeneity of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import Cube

#: Blocks, or runs of them, of one run of the level above (see ``Cube.files``).
FAN = 16

#: The names of the six rules, and the least threshold.
LEAST_THRESHOLD = 1e-7
STRATEGIES = ("fixed_strict", "arithmetic_mean", "median", "stddev_2x", "stddev_6x", "adaptive_local")


def beta(low: Column, high: Column) -> Column:
    """(high - low)^2 / (4 low high): 0 for equal ends (0, 0 too), infinite where an end is not positive."""
    lo, hi = low.cast("double"), high.cast("double")
    return F.when(lo == hi, F.lit(0.0)).when((lo <= 0) | (hi <= 0), F.lit(float("inf"))).otherwise((hi - lo) * (hi - lo) / (4 * lo * hi))


def block_betas(stats: DataFrame, k: float = 2.0) -> DataFrame:
    """block_id, n, beta of its key range, and whether it is homogeneous: beta < 1 / n^k."""
    b = beta(F.col("key_lo"), F.col("key_hi"))
    return stats.select("block_id", "n", b.alias("beta")).withColumn("homogeneous", F.col("beta") < 1 / F.pow(F.col("n").cast("double"), F.lit(k)))


def beta_threshold(rows: DataFrame, strategy: str, strict: float = 1e-6, least: float = LEAST_THRESHOLD) -> float:
    """The bound below which a range of keys counts as homogeneous, by one of six rules over all keys of ``rows``.

    arithmetic_mean: a tenth of the beta of the whole range; median: a thousandth of the median key; stddev_2x and stddev_6x: two
    and six standard deviations. Where the figure behind a rule is infinite, or 1 or less, and for no keys, it is ``strict``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "fixed_strict":
        return strict
    if strategy == "adaptive_local":
        return 0.0
    keys = rows.select(F.col("key").cast("double").alias("key"))
    r = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.stddev_pop("key").alias("spread"), F.count("key").alias("n"))
    r = r.select(beta(F.col("lo"), F.col("hi")).alias("beta"), "spread", "n").first()
    if not r["n"]:
        return strict
    if strategy == "arithmetic_mean":
        found = 0.1 * r["beta"] if r["beta"] != float("inf") else strict
    elif strategy == "median":
        middle = keys.agg(F.percentile_approx("key", 0.5, 1_000_000)).first()[0]
        found = 0.001 * middle if middle > 1 else strict
    else:
        found = {"stddev_2x": 2, "stddev_6x": 6}[strategy] * r["spread"] if r["spread"] > 1 else strict
    return max(found, least)


def statistics(cube: Cube) -> DataFrame:
    """One row: records, blocks, homogeneous blocks, levels (rows in blocks, and as many levels of runs of ``FAN`` above as lead to one)."""
    b = block_betas(cube.stats)
    levels = F.lit(1) + F.when(F.col("blocks") > 1, F.ceil(F.round(F.log(F.col("blocks").cast("double")) / F.log(F.lit(float(FAN))), 9))).otherwise(0)
    return b.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("blocks"), F.count_if("homogeneous").alias("homogeneous")).withColumn("levels", levels.cast("int"))


def dim_stats(rows: DataFrame, dims: list[str]) -> DataFrame:
    """dim, n, s, lo, hi, distinct_count of each dimension, in one pass."""
    rows = rows.select(F.posexplode(F.array(*[F.col(d).cast("long") for d in dims])).alias("i", "code"))
    name = F.element_at(F.array(*[F.lit(d) for d in dims]), F.col("i") + 1)
    return rows.groupBy(name.alias("dim")).agg(F.count("code").alias("n"), F.sum("code").alias("s"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.count_distinct("code").alias("distinct_count"))


def histogram(rows: DataFrame, dim: str, buckets: int = 8) -> DataFrame:
    """Equal-depth buckets from exact counts of codes: bucket, lo, hi, n. A code lies in one bucket only.

    Codes are counted before they are ordered, so what is ordered grows with the distinct codes, not with the rows.
    """
    counts = rows.filter(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("code")).agg(F.count("*").alias("c"))
    upto = Window.orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("c").over(upto)).crossJoin(F.broadcast(counts.agg(F.sum("c").alias("total"))))
    bucket = F.floor((F.col("upto") - F.col("c")) * buckets / F.col("total")).cast("long")
    return counts.groupBy(bucket.alias("bucket")).agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.sum("c").alias("n"))


def approximate_histogram(rows: DataFrame, dims: list[str], buckets: int = 8) -> DataFrame:
    """dim, bounds, distinct_count by Spark's sketches: one pass over many dimensions."""
    picks = [i / buckets for i in range(buckets + 1)]
    one = rows.agg(*[F.percentile_approx(d, picks, 10_000).alias(f"b_{d}") for d in dims], *[F.approx_count_distinct(d).alias(f"d_{d}") for d in dims])
    return one.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"b_{d}").alias("bounds"), F.col(f"d_{d}").alias("distinct_count")) for d in dims])).alias("x")).select("x.*")
