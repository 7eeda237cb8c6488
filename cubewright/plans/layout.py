"""Bulk load: range-partitioned, key-sorted Parquet with a statistics sidecar of one row a block."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schema import CubeSchema

#: Share of a block that a bulk load fills, by the workload it is meant for; the rest is room for later rows.
FILL = {"analytical": 0.70, "scan_heavy": 0.95, "write_heavy": 0.70, "balanced": 0.84, "custom": 0.84}
BLOCK_ROWS = 1 << 20


def rows_per_block(profile: str = "balanced", fill: float | None = None, block_rows: int = BLOCK_ROWS) -> int:
    """An explicit fill wins over the profile's; it is kept within a half and one."""
    share = min(1.0, max(0.5, FILL[profile] if fill is None else fill))
    return max(16, int(block_rows * share))


def block_stats(rows: DataFrame, schema: CubeSchema, by: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """One row a block: n, key_lo, key_hi and for each dimension sum_, min_, max_, nulls_."""
    per_dim = [f(d).alias(f"{p}_{d}") for d in schema.names for p, f in (("sum", F.sum), ("min", F.min), ("max", F.max))]
    nulls = [F.count_if(F.col(d).isNull()).alias(f"nulls_{d}") for d in schema.names]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("key").alias("key_lo"), F.max("key").alias("key_hi"), *per_dim, *nulls)


def merge_stats(stats: DataFrame, schema: CubeSchema, *by: str) -> DataFrame:
    """Statistics of groups of blocks from the blocks' own."""
    per_dim = [f(f"{p}_{d}").alias(f"{p}_{d}") for d in schema.names for p, f in (("sum", F.sum), ("min", F.min), ("max", F.max), ("nulls", F.sum))]
    return stats.groupBy(*by).agg(F.sum("n").alias("n"), F.min("key_lo").alias("key_lo"), F.max("key_hi").alias("key_hi"), *per_dim)


@dataclass(frozen=True)
class Cube:
    """A stored cube: its rows (dimension codes, key, value, block_id), sorted by key in blocks, and the blocks' statistics."""

    schema: CubeSchema
    path: str
    spark: SparkSession

    @property
    def rows(self) -> DataFrame:
        key = "BIGINT" if self.schema.total_bits <= 63 else "BINARY"
        columns = [*(f"{d} BIGINT" for d in self.schema.names), "value BIGINT", f"key {key}", "block_id INT"]
        return self.spark.read.schema(", ".join(columns)).parquet(f"{self.path}/base")  # no job to read footers

    def blocks(self, files: list[str]) -> DataFrame:
        """The rows of some blocks, given by their files: no other file is opened."""
        if not files:
            return self.spark.createDataFrame([], self.rows.schema)
        return self.spark.read.schema(self.rows.schema).parquet(*files)

    @property
    def stats(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/stats")

    def count(self) -> int:
        """Number of rows, from the sidecar."""
        return self.stats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def files(self, per_file: int = 16) -> DataFrame:
        """The level above the blocks: statistics of runs of ``per_file`` blocks."""
        return merge_stats(self.stats.withColumn("file_id", F.floor(F.col("block_id") / per_file)), self.schema, "file_id")


def bulk_load(rows: DataFrame, schema: CubeSchema, path: str, profile: str = "balanced", fill: float | None = None, block_rows: int = BLOCK_ROWS, dedup: bool = False, seq: str = "value") -> Cube:
    """Replace what is at ``path`` by ``rows`` (dimension codes and value; the key is derived).

    Equal keys are kept; with ``dedup`` the row of the greatest ``seq`` stays for each key. Blocks are ranges of keys, so a
    query on leading dimensions reads few of them.
    """
    rows = rows.select(*[F.col(c).cast("long").alias(c) for c in (*schema.names, "value")]).withColumn("key", schema.key())
    if dedup:
        last = Window.partitionBy("key").orderBy(F.desc(seq))
        rows = rows.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/staged")  # joins and windows behind the rows run once; sampling reads this
    rows = spark.read.schema(rows.schema).parquet(f"{path}/staged")
    blocks = max(1, -(-rows.count() // rows_per_block(profile, fill, block_rows)))
    laid = rows.repartitionByRange(blocks, "key", "value").withColumn("block_id", F.spark_partition_id()).sortWithinPartitions("key", "value")
    laid.write.mode("overwrite").parquet(f"{path}/base")
    jvm = spark.sparkContext._jvm
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}/staged")
    staged.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(staged, True)
    cube = Cube(schema, path, spark)
    # a block is one file, which its statistics name
    block_stats(cube.rows.withColumn("file", F.input_file_name()), schema, ("block_id", "file")).write.mode("overwrite").parquet(f"{path}/stats")
    _SIDECARS.pop(path, None)
    return cube


#: Blocks whose statistics the driver keeps at most; more stay a table.
SIDECAR_BLOCKS = 10_000
_SIDECARS: dict[str, DataFrame | None] = {}


def sidecar(cube: Cube) -> DataFrame | None:
    """The statistics as a local table, read once: tests on them run no job. None where there are more than ``SIDECAR_BLOCKS``."""
    if cube.path not in _SIDECARS:
        rows = cube.stats.limit(SIDECAR_BLOCKS + 1).toArrow()  # comes back as a local relation, not as a job
        _SIDECARS[cube.path] = cube.spark.createDataFrame(rows) if rows.num_rows <= SIDECAR_BLOCKS else None
    return _SIDECARS[cube.path]
