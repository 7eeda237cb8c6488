"""Choosing the exponent k of the homogeneity rule from measured runs."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("log_n", "k", "log_beta", "cv", "skew")


def data_features(rows: DataFrame, key: str = "key") -> DataFrame:
    """One row: log of the count, log of the whole range's beta, coefficient of variation and skewness of the keys."""
    c = F.col(key).cast("double")
    lo, hi = F.min(c), F.max(c)
    beta = F.when(lo > 0, (hi - lo) * (hi - lo) / (4 * lo * hi)).otherwise(F.lit(0.0))
    return rows.agg(F.log(F.count("*").cast("double")).alias("log_n"), F.log(beta + 1e-15).alias("log_beta"), (F.stddev_pop(c) / F.avg(c)).alias("cv"), F.skewness(c).alias("skew"))


def score(runs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted log speed-ups of each run (run, query, base_ms, own_ms): run, score."""
    table = F.create_map(*[x for q, w in weights.items() for x in (F.lit(q), F.lit(float(w)))])
    gain = F.try_element_at(table, F.col("query")) * F.log(F.col("base_ms") / F.col("own_ms"))
    return runs.groupBy("run").agg(F.sum(gain).alias("score"))


def fit(samples: DataFrame, model: str = "gbt", rounds: int = 200):
    """Predict the score from ``FEATURES``: boosted trees of depth 4, or a polynomial of degree 3."""
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    if model == "gbt":
        steps = [assemble, GBTRegressor(featuresCol="x", labelCol="score", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=1)]
    elif model == "polynomial":
        steps = [assemble, PolynomialExpansion(degree=3, inputCol="x", outputCol="px"), LinearRegression(featuresCol="px", labelCol="score", regParam=1e-6)]
    else:
        raise ValueError(f"unknown model {model}")
    return Pipeline(stages=steps).fit(samples)


def best_k(model, features: DataFrame, low: float = 1.0, high: float = 3.5, step: float = 0.05) -> float:
    """The k of the grid with the greatest predicted score (ties: the smaller)."""
    grid = F.explode(F.array(*[F.lit(round(low + i * step, 6)) for i in range(int(round((high - low) / step)) + 1)]))
    predicted = model.transform(features.drop("k").withColumn("k", grid))
    return predicted.orderBy(F.desc("prediction"), "k").first()["k"]


def timings(samples: list[float]) -> dict[str, float]:
    """mean, p50, p95, min and max of run times; under 20 runs the p95 is the greatest."""
    s = sorted(samples)
    return {"mean": reduce(lambda a, b: a + b, s) / len(s), "p50": s[len(s) // 2], "p95": s[min(len(s) - 1, int(0.95 * len(s)))] if len(s) >= 20 else s[-1], "min": s[0], "max": s[-1]}
