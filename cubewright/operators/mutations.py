"""Changes to stored rows as DataFrames: inserts, deletes of one occurrence, updates, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import CubeSchema
from ..plans.layout import Cube, block_stats, bulk_load
from ..storage import shared_path


def insert(rows: DataFrame, delta: DataFrame) -> DataFrame:
    """All rows of both; equal keys are kept."""
    return rows.unionByName(delta.select(*rows.columns))


def remove_one_each(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows without one occurrence for each row of ``keys`` (column dk); the occurrences of least value go first.

    Only rows of keys that are to be deleted are ranked. A key that is absent removes nothing.
    """
    counts = keys.groupBy("dk").agg(F.count("*").alias("_dn"))
    hit = rows.join(counts, F.col("key") == F.col("dk"), "left")
    kept = hit.filter(F.col("_dn").isNull())
    order = Window.partitionBy("key").orderBy("value")
    ranked = hit.filter(F.col("_dn").isNotNull()).withColumn("_rn", F.row_number().over(order)).filter("_rn > _dn").drop("_rn")
    return kept.unionByName(ranked).drop("dk", "_dn")


def update(rows: DataFrame, schema: CubeSchema, changes: DataFrame, on: str = "value") -> DataFrame:
    """Replace the codes of rows found by ``on`` (unique in ``changes``, which holds it and new codes); the key follows the codes."""
    renamed = changes.select(F.col(on).alias("_on"), *[F.col(d).alias(f"_{d}") for d in schema.names], F.lit(True).alias("_new"))
    out = rows.join(renamed, F.col(on) == F.col("_on"), "left")
    cols = [F.when(F.col("_new"), F.col(f"_{d}")).otherwise(F.col(d)).alias(d) for d in schema.names]
    return out.select(*cols, "value").withColumn("key", schema.key())


def dedup_last(rows: DataFrame, seq: str = "value") -> DataFrame:
    """One row a key: the one of greatest ``seq``. Only the winner's columns travel; no sort of the copies."""
    rest = [c for c in rows.columns if c != "key"]
    best = rows.groupBy("key").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return best.select("key", "_r.*").select(*rows.columns)


def live(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows without one occurrence of (key, value) for each tombstone: of two equal rows, one tombstone leaves one.

    Only rows that a tombstone names are ranked.
    """
    counts = tombstones.groupBy("key", "value").agg(F.count("*").alias("_dn"))
    hit = rows.join(counts, ["key", "value"], "left")
    kept = hit.filter(F.col("_dn").isNull())
    order = Window.partitionBy("key", "value").orderBy(F.lit(0))  # equal rows: any will do
    ranked = hit.filter(F.col("_dn").isNotNull()).withColumn("_rn", F.row_number().over(order)).filter("_rn > _dn")
    return kept.select(*rows.columns).unionByName(ranked.select(*rows.columns))


class MutableCube:
    """A stored cube with a delta of appended rows and a table of tombstones; reads see both, ``compact`` folds them in."""

    def __init__(self, cube: Cube):
        self.cube, self.spark, self.schema = cube, cube.spark, cube.schema
        self._deltas: list[str] = []
        self._dead: list[str] = []

    def insert(self, rows: DataFrame, path: str | None = None) -> None:
        """Append rows as a delta block of its own; at a given ``path`` the same rows can be written again and count once."""
        again = path in self._deltas
        block = -1 - (self._deltas.index(path) if again else len(self._deltas))
        path = path or shared_path(self.spark, "delta")
        rows.select(*self.schema.names, "value").withColumn("key", self.schema.key()).withColumn("block_id", F.lit(block)).write.mode("overwrite").parquet(path)
        if not again:
            self._deltas.append(path)

    def attach(self, folder: str) -> None:
        """Take up the finished deltas under a folder that an earlier session wrote."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(root)] if fs.exists(root) else []
        self._deltas += [p for p in sorted(found) if p not in self._deltas and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]

    @property
    def rows(self) -> DataFrame:
        all_rows = self.cube.rows
        if self._deltas:
            all_rows = all_rows.unionByName(self.spark.read.parquet(*self._deltas))
        return live(all_rows, self.spark.read.parquet(*self._dead)) if self._dead else all_rows

    @property
    def stats(self) -> DataFrame:
        """Delta blocks have statistics of their own; where rows are dead, the touched blocks are counted anew."""
        if self._dead:
            return block_stats(self.rows, self.schema)
        if self._deltas:  # the base is as it was: only the deltas are counted
            return self.cube.stats.drop("file").unionByName(block_stats(self.spark.read.parquet(*self._deltas), self.schema))
        return self.cube.stats

    def remove(self, keys: DataFrame) -> int:
        """Remove one occurrence for each row of ``keys`` (column dk); how many were there to remove."""
        counts = keys.groupBy("dk").agg(F.count("*").alias("_dn"))
        order = Window.partitionBy("key").orderBy("value")
        dead = self.rows.join(counts, F.col("key") == F.col("dk")).withColumn("_rn", F.row_number().over(order)).filter("_rn <= _dn").select("key", "value")
        path = shared_path(self.spark, "tombstones")
        dead.write.parquet(path)
        self._dead.append(path)
        return self.spark.read.parquet(path).count()

    def update(self, changes: DataFrame) -> None:
        """Give rows (by value) new codes: the old version dies, the new one is appended under a new value."""
        self.rows.join(changes.select("value"), "value", "left_semi").select("key", "value").write.parquet(path := shared_path(self.spark, "tombstones"))
        self.insert(changes.withColumn("value", F.col("new_value")))
        self._dead.append(path)

    def count(self) -> int:
        return self.rows.count()

    def compact(self, path: str | None = None, **layout) -> MutableCube:
        """Rewrite all live rows as a fresh cube without delta or tombstones."""
        return MutableCube(bulk_load(self.rows, self.schema, path or shared_path(self.spark, "cube"), **layout))
