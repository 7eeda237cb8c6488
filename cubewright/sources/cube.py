"""The cube over the star-schema tables, and stored cubes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import orders_schema
from ..plans.layout import Cube, bulk_load
from ..storage import shared_path

SCHEMA = orders_schema()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order, customer and part as year, month, day, state, product, price, version (codes), value and key."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    d = SCHEMA.dim
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(
        d("year").encode(F.year("l_shipdate")).alias("year"), d("month").encode(F.month("l_shipdate")).alias("month"), d("day").encode(F.day("l_shipdate")).alias("day"),
        F.col("c_nationkey").cast("long").alias("state"), F.substring("p_brand", 7, 10).cast("long").alias("product"),
        d("price").encode_float(F.col("l_extendedprice")).alias("price"), d("version").encode_float(F.col("l_discount")).alias("version"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("value"))
    return rows.withColumn("key", SCHEMA.key())


_STORED: dict[tuple[str, str], Cube] = {}


def stored_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """The bulk-loaded cube of a directory's tables; loaded once a session, as queries on an index assume."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STORED:
        n = table(spark, sf_dir, "lineitem").count()  # small tables get small blocks, so that there are some to skip
        _STORED[at] = bulk_load(cube_view(spark, sf_dir), SCHEMA, shared_path(spark, "cube"), block_rows=max(4096, min(1 << 20, n // 24)))
    return _STORED[at]
