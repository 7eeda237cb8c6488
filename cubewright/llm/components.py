"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Counted edges that one task may settle in its memory (16 bytes each); more take rounds of joins.
SMALL_EDGES = 200_000


def _settled(batches):
    """The labels of all edges of one task, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = np.array(sorted(parent), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.array([root(int(x)) for x in nodes], np.int64))], ["node", "comp"])


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether each node has one parent and no parent has a parent."""
    return e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and e.groupBy("u").count().filter("count > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the least node reachable.

    A few edges, by count, are settled by one task. For more, every step is an aggregation and a join; tables are written between
    the steps, so that adaptive execution can split a node of very many edges and lost executors cost one step. Rounds grow with the logarithm of the longest path.
    """
    e = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "cc")
    if e.count() <= SMALL_EDGES:
        out = materialize(e.coalesce(1).mapInArrow(_settled, "node long, comp long"), "cc-labels")
        discard(e)
        return out
    while not _is_forest_of_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialize(large, "cc-large")
        parent = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-parent")
        small = large.join(parent, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        old, e = e, materialize(small.unionByName(parent.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(old, least, large, parent)
    out = materialize(e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), "cc-labels")
    discard(e)
    return out
