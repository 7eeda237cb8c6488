"""Contiguous shards of equal bytes from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def balanced_shards(docs: DataFrame, shards: int = 24, per_row: int = 8, partitions: int | None = None) -> DataFrame:
    """Cut all rows, in the order of (hash of the text, doc_id), into ``shards`` contiguous runs of nearly equal bytes.

    A row's size is the UTF-8 bytes of its text plus ``per_row``; a row goes to the shard that holds its middle byte,
    so a shard's bytes are off the equal target by less than its two border rows. Equal texts lie next to each other:
    a group of copies is split only where a cut falls into it.

    The order is range-partitioned, which also splits a group of copies by doc_id. Each partition sums its own sizes; the
    few totals become offsets; a row's global prefix is its partition's offset plus a running sum inside the partition.

    Null text: no bytes (size ``per_row``, crc32 0). Null doc_id sorts first. Repeated rows each get their own slot
    (ties are ordered by all that is returned, so they can't be told apart). Empty table: no rows. Other columns of
    ``docs`` are not looked at. Returns doc_id, size, text_crc32, shard, slot.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = F.coalesce(docs["text"].cast("binary"), F.lit(b""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + per_row).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("h"),
    )
    rows = materialize(rows, "shard-rows")  # the text is read once
    order = ["h", "doc_id", "size", "text_crc32"]
    rows = materialize(rows.repartitionByRange(partitions, *order).withColumn("pid", F.spark_partition_id()), "shard-ranges")
    totals = rows.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    all_rows = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "pid",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(all_rows).alias("total"),
    )
    inside = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rows.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(inside).cast("long"))
        .join(F.broadcast(offsets), "pid")  # as many rows as there are partitions
        .withColumn("middle", (F.col("bytes_before") + F.col("upto")) * 2 - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(middle * {shards}) div (2 * total)")).cast("int"))
        .withColumn("at", F.col("rows_before") + F.col("nth") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "at")
    )
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))  # firsts: one row a shard


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = balanced_shards(docs, shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
