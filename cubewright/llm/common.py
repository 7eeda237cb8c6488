"""What the operators share: scratch tables, size-checked joins and splits by crc32."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two longs that a broadcast may hold; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, wherever the driver has it from."""
    sc = spark.sparkContext
    if getattr(sc, "_cubewright_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="cubewright-")) / "cubewright_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path(package.name) / f.relative_to(package))
    sc.addPyFile(str(target))
    sc._cubewright_shipped = True


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Pass texts to Python in batches of at most so many rows: their Arrow buffers lie outside the heap, one for each task and step."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cubewright-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more. Other DataFrames, and None, are left alone."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            remove_path(t.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_ids(df: DataFrame, ids: DataFrame, key: str, how: str, rows: int | None = None) -> DataFrame:
    """Join ``df`` to a narrow table by ``key``: broadcast if the table's counted rows are few, else shuffled."""
    rows = ids.count() if rows is None else rows
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, key, how)


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32(doc_id as text) mod ``folds`` is 0; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def text_bytes(df: DataFrame) -> int:
    """Bytes of the scanned input by Spark's statistics, or counted where the statistics say nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return size


def buckets_for(df: DataFrame, each: int = 2 << 20, least: int = 12) -> int:
    """How many buckets deal out what is derived from ``df``, for some ``each`` input bytes a bucket."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, conf, -(-text_bytes(df) // each))
