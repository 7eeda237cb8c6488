"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, ship


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of at most k clusters (Lloyd's rounds from a k-means++ start)."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[rng.integers(len(x))][None].copy()
    near = ((x - c[0]) ** 2).sum(1)
    while len(c) < k:
        total = near.sum()
        pick = x[rng.choice(len(x), p=near / total)] if total > 0 else x[len(c)]
        c = np.concatenate([c, pick[None]])
        near = np.minimum(near, ((x - pick) ** 2).sum(1))
    for _ in range(rounds):
        own = _nearest(x, c)
        for j in range(k):
            if (mine := own == j).any():
                c[j] = x[mine].mean(0)
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def traverse(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) by growing d1[i] + d2[j]: the multi-sequence algorithm with a heap."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, pushed = [(float(d1[o1[0]] + d2[o2[0]]), 0, 0)], {(0, 0)}
    while heap:
        _, a, b = heapq.heappop(heap)
        yield int(o1[a]), int(o2[b])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(o1) and y < len(o2) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (float(d1[o1[x]] + d2[o2[y]]), x, y))


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) in double precision of the rows that take part: no null id, null or empty vector, null or non-finite component, zero vector."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine)


def measured_probe(x: np.ndarray, c1: np.ndarray, c2: np.ndarray, k: int, recall: float, queries: int = 200) -> float:
    """The share of all vectors that traversal must pass to hold ``recall`` of the ``k`` nearest ones, measured inside a sample.

    ``queries`` of the sample's vectors are searched exactly in the sample; each true neighbour lies behind some share of it in the
    order of the pairs. In a larger table neighbours are nearer, so the share that is found is no smaller.
    """
    if len(x) <= k + 1:
        return 1.0
    half = c1.shape[1]
    d1, d2 = _squares(x[:, :half], c1), _squares(x[:, half:], c2)
    i, j = d1.argmin(1), d2.argmin(1)
    at = np.linspace(0, len(x) - 1, min(queries, len(x))).astype(np.int64)
    behind = []
    for q in np.unique(at):
        own = d1[q][i] + d2[q][j]  # what the traversal sorts each vector's pair by
        true = np.argpartition(((x - x[q]) ** 2).sum(1), k + 1)[: k + 1]
        passed = np.sort(own)
        behind.append(np.searchsorted(passed, own[true[true != q][:k]], side="right") / len(x))
    return float(np.quantile(np.concatenate(behind), recall))


def search(
    table: DataFrame, every: int = 100, k: int = 10, centroids: int | None = None, sample: int = 20_000, probe: float | None = None, recall: float = 0.97, block: int = 4000
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query (vec_id divisible by ``every``) among all others.

    Each half of the vectors is quantised by ``centroids`` centroids (by default 4 times the fourth root of the number of vectors,
    128 to 1024), fitted on at most ``sample`` vectors (least hash of the id); every row is entered under its pair of centroids.
    A query takes pairs in the order of summed squared distance until they hold the share ``probe`` of all distinct vectors (and
    k + 1 rows at least), and their rows are ranked by exact distance in double precision. By default the share is the one that
    finds ``recall`` of the nearest in the sample (see ``measured_probe``); ``probe`` 1 takes all pairs: exact search.

    The entries of one first centroid lie in blocks of some ``block`` rows. Every entry moves once, to its block; a query moves once
    to each block that it probes, and is ranked as it comes by, so a task holds one block and one Arrow batch of queries.

    Equal vectors are one entry, which holds its k + 1 least ids: more can't be among the k nearest. Ties go to the smaller
    vec_id. Rows of an id that repeats with one vector count once. Vectors of another dimension than the most common one take
    no part (of equally common ones the smallest counts). Null ids, and vectors that are null, zero or hold a null or non-finite
    component, take no part. Fewer rows than k: all of them. Empty table: no rows. Other columns are not looked at.
    """
    spark = table.sparkSession
    ship(spark)
    rows = vectors(table)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, half = dims["d"], dims["d"] // 2
    rows = rows.filter(F.size("v") == dim)
    least = Window.partitionBy("v").orderBy("vec_id")  # each task sends at most k + 1 ids of a vector
    entries = rows.dropDuplicates(["vec_id", "v"]).withColumn("r", F.row_number().over(least)).filter(F.col("r") <= k + 1)
    entries = materialize(entries.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "imi-entries")
    n = entries.count()
    taken = entries.orderBy(F.xxhash64(F.col("ids")[0])).limit(sample).select("v").toPandas()
    x = np.array(taken["v"].tolist(), dtype=float)
    most = centroids or min(1024, max(128, int(4 * n**0.25)))
    c1, c2 = kmeans(x[:, :half], most) if half else np.zeros((1, 0)), kmeans(x[:, half:], most)
    share = measured_probe(x, c1, c2, k, recall) if probe is None else probe
    width = len(c2)

    def matrix(col) -> np.ndarray:
        return np.asarray(col.flatten()).reshape(-1, dim) if len(col) else np.zeros((0, dim))

    def enter(batches):
        for b in batches:
            m = matrix(b.column("v"))
            yield pa.RecordBatch.from_arrays([pa.array(_nearest(m[:, :half], c1)), pa.array(_nearest(m[:, half:], c2)), b.column("ids"), b.column("v")], ["i", "j", "ids", "v"])

    index = materialize(entries.select("ids", "v").mapInArrow(enter, "i long, j long, ids array<bigint>, v array<double>"), "imi-index")
    discard(entries)
    sizes = np.zeros((len(c1), len(c2)), np.int64)
    counts = index.groupBy("i", "j").count().toArrow()  # at most centroids ** 2 rows
    sizes[counts.column("i").to_numpy(), counts.column("j").to_numpy()] = counts.column("count").to_numpy()
    blocks = np.maximum(1, -(-sizes.sum(1) // block))
    want = min(n, max(k + 1, int(np.ceil(share * n))))

    def probes(batches):
        for b in batches:
            m = matrix(b.column("v"))
            ids = b.column("vec_id").to_numpy()
            d1, d2 = _squares(m[:, :half], c1), _squares(m[:, half:], c2)
            for q in range(len(m)):
                got, cells = 0, {}
                for i, j in traverse(d1[q], d2[q]):
                    if sizes[i, j]:
                        got += sizes[i, j]
                        cells.setdefault(i, []).append(j)
                        if got >= want:
                            break
                at = [(i, part, js) for i, js in cells.items() for part in range(blocks[i])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in at], pa.int64()), pa.array([x[1] for x in at], pa.int32()), pa.array([x[2] for x in at], pa.list_(pa.int64())),
                        pa.array(np.full(len(at), ids[q])), pa.array([m[q].tolist()] * len(at), pa.list_(pa.float64())),
                    ], ["i", "part", "js", "query_id", "v"])

    # an id that repeats with several vectors is a query for each of them; the nearest of them all are ranked together
    own = rows.filter(F.col("vec_id") % every == 0).distinct().repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = own.mapInArrow(probes, "i long, part int, js array<bigint>, query_id long, v array<double>")
    each = F.element_at(F.array(*[F.lit(int(x)) for x in blocks]), F.col("i").cast("int") + 1)
    held = index.withColumn("part", F.pmod(F.xxhash64(F.col("ids")[0]), each).cast("int"))
    # kind 0: entries (js holds their second centroid), kind 1: queries (ids holds the query's)
    left = held.select("i", "part", F.lit(0).alias("kind"), F.array("j").alias("js"), "ids", "v")
    right = asked.select("i", "part", F.lit(1).alias("kind"), "js", F.array("query_id").alias("ids"), "v")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (4 * block)))
    both = left.unionByName(right).repartition(tasks, "i", "part").sortWithinPartitions("i", "part", "kind")

    def rank(batches):
        at, e, js, ids = None, [], [], []  # the block whose queries come by
        wanted = np.zeros(width, bool)
        for b in batches:
            i, part, kind = (b.column(c).to_numpy() for c in ("i", "part", "kind"))
            cut = np.flatnonzero((np.diff(i) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            got = []
            for first, last in zip([0, *cut], [*cut, len(i)], strict=True):
                if first == last:
                    continue
                run = b.slice(first, last - first)
                if at != (here := (i[first], part[first])):
                    at, e, js, ids = here, [], [], []
                m = matrix(run.column("v"))
                if kind[first] == 0:
                    e.append(m)
                    js.append(run.column("js").flatten().to_numpy())
                    ids += run.column("ids").to_pylist()
                    continue
                if not e:
                    continue
                if len(e) > 1:
                    e, js = [np.concatenate(e)], [np.concatenate(js)]
                for (name,), q, mine in zip(run.column("ids").to_pylist(), m, run.column("js").to_pylist(), strict=True):
                    wanted[:] = False
                    wanted[mine] = True
                    near = np.flatnonzero(wanted[js[0]])
                    if not len(near):
                        continue
                    d = np.sqrt(((e[0][near] - q) ** 2).sum(1))
                    far = np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)]
                    top = np.flatnonzero(d <= far)  # all ties too
                    got += sorted((name, d[t], v) for t in top for v in ids[near[t]] if v != name)[:k]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([float(g[1]) for g in got], pa.float64())], ["query_id", "vec_id", "score"])

    near = both.mapInArrow(rank, "query_id long, vec_id long, score double")
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
