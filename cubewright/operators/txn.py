"""Epochs: versioned rows, snapshot reads, a log that can be replayed."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_path


def snapshot(versions: DataFrame, epoch: int) -> DataFrame:
    """Rows visible at an epoch: made by then (xmin) and not yet gone (xmax, null: never)."""
    return versions.filter((F.col("xmin") <= epoch) & (F.col("xmax").isNull() | (F.col("xmax") > epoch)))


class Log:
    """An append-only log of committed transactions; each commit writes its changes, then a marker.

    A commit whose marker is missing never happened. ``recover`` replays what is committed: the state after a crash.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "log")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def epochs(self) -> list[int]:
        """Committed epochs in order."""
        fs, jvm = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        found = [n for n in names if n.startswith("epoch=")]
        return sorted(int(n[6:]) for n in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def begin(self) -> Transaction:
        return Transaction(self)

    def changes(self) -> DataFrame | None:
        """All committed changes: op (insert or delete), epoch and the row."""
        done = self.epochs()
        if not done:
            return None
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/epoch={e}").withColumn("epoch", F.lit(e)) for e in done])

    def recover(self) -> dict:
        """Counts of committed transactions and of the records to be redone."""
        changes = self.changes()
        return {"committed_txns": len(self.epochs()), "redo_records": changes.count() if changes is not None else 0}

    def versions(self, base: DataFrame | None = None) -> DataFrame:
        """All versions of all rows with xmin and xmax; rows of ``base`` are there since epoch 0."""
        changes = self.changes()
        if changes is None:
            return base.withColumn("xmin", F.lit(0)).withColumn("xmax", F.lit(None).cast("int"))
        born = changes.filter("op = 'insert'").drop("op").withColumnRenamed("epoch", "xmin")
        if base is not None:
            born = base.withColumn("xmin", F.lit(0)).unionByName(born.select(*base.columns, "xmin"))
        gone = changes.filter("op = 'delete'").groupBy("value").agg(F.collect_set("epoch").alias("_gone"))  # one value's deletes
        ends = F.array_min(F.filter("_gone", lambda e: e > F.col("xmin")))  # a birth ends with the next delete after it
        return born.join(gone, "value", "left").withColumn("xmax", ends).drop("_gone")

    def checkpoint(self, base: DataFrame | None = None) -> DataFrame:
        """The live rows after all commits, written out; the log's earlier part is no longer needed with it."""
        done = self.epochs()
        path = shared_path(self.spark, "checkpoint")
        snapshot(self.versions(base), done[-1] if done else 0).drop("xmin", "xmax").write.parquet(path)
        return self.spark.read.parquet(path)


class Transaction:
    """Changes that become visible together at commit, or not at all."""

    def __init__(self, log: Log):
        self.log, self.parts = log, []

    def insert(self, rows: DataFrame) -> None:
        self.parts.append(rows.withColumn("op", F.lit("insert")))

    def delete(self, rows: DataFrame) -> None:
        """Rows given whole; they are found again by value."""
        self.parts.append(rows.withColumn("op", F.lit("delete")))

    def commit(self) -> int:
        """Write the changes aside, then publish them by one rename; what a crash leaves aside is never read. The next free epoch
        is taken, also past a folder that an earlier crash left without its marker."""
        if not self.parts:
            done = self.log.epochs()
            return (done[-1] if done else 0) + 1
        fs, jvm = self.log._fs()
        path = jvm.org.apache.hadoop.fs.Path
        aside = f"{self.log.path}/aside-{uuid.uuid4().hex}"
        reduce(DataFrame.unionByName, self.parts).write.parquet(aside)
        names = [s.getPath().getName() for s in fs.listStatus(path(self.log.path))]
        epoch = max([0, *(int(n[6:]) for n in names if n.startswith("epoch="))]) + 1
        while fs.exists(path(f"{self.log.path}/epoch={epoch}")) or not fs.rename(path(aside), path(f"{self.log.path}/epoch={epoch}")):
            epoch += 1
        self.parts = []
        return epoch

    def abort(self) -> None:
        self.parts = []
