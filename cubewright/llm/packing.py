"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import NOT_SPACE, Words, chunks


def price(size: int, quadratic: int = 8192) -> float:
    """What a sequence of a length costs: its tokens, and attention that grows with their square."""
    return size * (1 + size / quadratic)


def pack(lengths: np.ndarray, sizes: tuple[int, ...], quadratic: int = 8192) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each piece, offset in its bin, final size of each bin) for pieces of at most max(sizes) tokens.

    Longest pieces first (ties: first given). A piece goes into the open bin with the least room that still holds it. If none
    does, a bin is opened; its size is the permitted one of least price for each token it can come to hold: the piece and as
    many tokens of the pieces still to come, no longer than its room, as fit. At the end each bin shrinks to the least
    permitted size that holds its contents.
    """
    sizes = tuple(sorted(sizes))
    order = np.argsort(-lengths, kind="stable")
    ascending = lengths[order][::-1]
    sums = np.concatenate([[0], np.cumsum(ascending)])  # tokens of the n shortest pieces
    prices = [price(s, quadratic) for s in sizes]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    capacity: list[int] = []
    for done, i in enumerate(order):
        n = int(lengths[i])
        k = bisect_left(rooms, (n, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            left = len(order) - done - 1  # pieces still to come are the `left` shortest
            best, at = None, 0
            for s, p in zip(sizes, prices, strict=True):
                if s >= n:
                    fits = min(left, int(np.searchsorted(ascending, s - n, side="right")))
                    cost = p / (n + min(s - n, int(sums[fits]))) if n or fits else p
                    if best is None or cost < best:
                        best, at = cost, s
            b, room = len(used), at
            used.append(0)
            capacity.append(at)
        where[i], offset[i] = b, used[b]
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    final = [next(s for s in sizes if s >= u) for u in used]
    return where, offset, final


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words, runs of anything but ASCII white space, stand for tokens; null text has none."""

    def count(batches):
        for b in batches:
            n = [w.counts for _, _, buf, offs in chunks(b.column("text")) for w in [Words(buf, offs, NOT_SPACE)]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], ["doc_id", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(count, "doc_id long, n_tokens long")


def best_fit(docs: DataFrame, sizes: tuple[int, ...] = (512, 1024, 2048, 4096), each: int = 20_000) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, bin, bin_size, bin_offset.

    A document longer than the largest size is cut into pieces of that size and a rest. Pieces are dealt by a hash of doc_id
    (and piece) into groups of some ``each`` pieces; each group is packed by itself by ``pack``, so a bin's pieces are all of
    its group and ``bin`` is "group-number". The groups depend on the rows alone, not on how they lie in partitions.

    Null or wordless text: one piece of length 0. Null ids and repeated rows are packed like any other, each by itself.
    Empty table: no rows. Other columns are not looked at.
    """
    most = max(sizes)
    counts = materialize(token_counts(docs), "bf-counts")  # the text is read once
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / most)).cast("int")
    pieces = counts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.col("n_tokens") - F.col("piece").cast("long") * most, F.lit(most)).alias("length"))
    total = counts.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / most)))).first()[0] or 0
    groups = max(1, -(-int(total) // each))
    # null ids have nothing to be dealt by but their row's place
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        doc = table.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), doc))
        table = table.take(pa.array(order))
        where, offset, final = pack(table.column("length").to_numpy(), sizes)
        g = table.column("grp")[0].as_py()
        size = np.array(final, np.int64)
        return pa.table({
            "doc_id": table.column("doc_id"), "piece": table.column("piece"), "start": table.column("start"), "length": table.column("length"),
            "bin": pa.array([f"{g}-{b}" for b in where], pa.string()), "bin_size": pa.array(size[where]), "bin_offset": pa.array(offset)})

    return pieces.groupBy("grp").applyInArrow(run, "doc_id long, piece int, start long, length long, bin string, bin_size long, bin_offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies: the last stage."""
    return best_fit(docs)
