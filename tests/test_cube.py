"""Layout, planner, mutations and transactions."""

import random

import pytest
from pyspark.sql import functions as F

from cubewright.functions.predicates import KeyRange, Predicate, PredicateSet, between, eq, isin
from cubewright.functions.schema import CubeSchema, Dimension, sales_schema
from cubewright.operators import analytics, mutations, scan, txn
from cubewright.plans import layout, planner, stats
from cubewright.sources.generators import DISTRIBUTIONS, generate

TINY = CubeSchema((Dimension("a", 6), Dimension("b", 6), Dimension("m", 16)))


@pytest.fixture(scope="module")
def cube(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(rng.randrange(8), rng.choice([None, *range(20)]), rng.randrange(1000), i) for i in range(3000)]
    rows += [(3, 3, 3, 10_000 + i) for i in range(400)]  # one key fills several blocks
    df = spark.createDataFrame(rows, "a long, b long, m long, value long")
    return layout.bulk_load(df, TINY, str(tmp_path_factory.mktemp("cube")), fill=1.0, block_rows=150)


PREDICATES = [
    eq("a", 3), Predicate("a", "neq", (3,)), Predicate("b", "lt", (4,)), Predicate("b", "lte", (4,)), Predicate("m", "gt", (900,)), Predicate("a", "gte", (7,)),
    between("a", 2, 4), between("a", 4, 2), isin("a", 1, 6), isin("a"), Predicate("b", "is_null"), Predicate("b", "is_not_null"), Predicate("a", "like", ("3%",)),
]


@pytest.mark.parametrize("p", PREDICATES, ids=str)
def test_pruned_search_is_the_plain_filter(cube, p):
    want = sorted(r["value"] for r in cube.rows.filter(p.column(TINY)).collect())
    for worth in (-1.0, 2.0):  # always by blocks, never by blocks
        assert sorted(r["value"] for r in planner.search(cube, PredicateSet.of(p), worth).collect()) == want
    n, s = planner.filtered_aggregate(cube, PredicateSet.of(p), "m").first()
    assert n == len(want)
    assert s == (cube.rows.filter(p.column(TINY)).agg(F.sum("m")).first()[0] or 0)


def test_statistics_prune_and_accept(cube):
    assert cube.stats.count() > 10
    p = planner.plan(cube, PredicateSet.of(eq("a", 7)))
    assert p.strategy == "blocks" and p.skipped > p.scanned
    assert p.estimated_rows < cube.count() == 3400


def test_range_aggregate_is_the_scan(cube):
    keys = sorted(r["key"] for r in cube.rows.select("key").collect())
    rng = random.Random(5)
    ranges = [(0, 1 << 40), (5, 4), (keys[0], keys[0]), *[tuple(sorted(rng.sample(keys, 2))) for _ in range(6)]]
    for lo, hi in ranges:
        n, s = planner.range_aggregate(cube, "m", lo, hi).first()
        w = cube.rows.filter(F.col("key").between(lo, hi)).agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
        assert (n, s) == tuple(w)


def test_range_aggregates_add_up(cube):
    mid = TINY.pack({"a": 4})
    parts = [planner.range_aggregate(cube, "m", lo, hi).first() for lo, hi in ((0, mid - 1), (mid, 1 << 40), (0, 1 << 40))]
    assert [a + b for a, b in zip(*parts[:2], strict=True)] == list(parts[2])


def test_empty_cube(spark, tmp_path):
    empty = layout.bulk_load(spark.createDataFrame([], "a long, b long, m long, value long"), TINY, str(tmp_path))
    assert empty.count() == 0
    assert tuple(planner.range_aggregate(empty, "m", 0, 9).first()) == (0, 0)
    assert planner.search(empty, PredicateSet.of(eq("a", 1))).count() == 0
    assert planner.plan(empty, PredicateSet()).strategy == "scan"


def test_key_filters_reach_the_scan(cube):
    low, high = (lambda b: (b["key_lo"] + 1, b["key_hi"]))(cube.stats.orderBy("key_lo").first())  # crosses a block's end
    plan = planner.range_aggregate(cube, "m", low, high)._jdf.queryExecution().executedPlan().toString()
    assert f"PushedFilters: [IsNotNull(key), GreaterThanOrEqual(key,{low}), LessThanOrEqual(key,{high})" in plan


def test_key_ranges():
    low, high = PredicateSet.of(eq("a", 2), between("b", 1, 3)).key_range(TINY)
    assert low == TINY.pack({"a": 2, "b": 1}) and high == TINY.pack({"a": 2, "b": 3, "m": TINY.dim("m").mask})
    r = KeyRange(3, 7)
    assert r.contains(7) and not r.contains(8) and r.overlaps(KeyRange(7, 9)) and r.fully_contains(KeyRange(4, 5)) and KeyRange(2, 1).is_empty()


def test_cursors(cube):
    keys = [r["key"] for r in scan.cursor(cube.rows)]
    assert keys == sorted(keys) and len(keys) == 3400
    assert [r["key"] for r in scan.cursor(cube.rows, keys[10], keys[20])] == [k for k in keys if keys[10] <= k <= keys[20]]
    assert scan.lower_bound(cube.rows, keys[50]).first()["key"] == keys[50]
    assert scan.upper_bound(cube.rows, keys[50]).first()["key"] > keys[50]
    assert [r["key"] for r in scan.ordered(cube.rows, True).limit(3).collect()] == keys[::-1][:3]
    assert scan.point(cube.rows, TINY.pack({"a": 3, "b": 3, "m": 3})).count() >= 400


def test_fill():
    assert layout.rows_per_block("scan_heavy", None, 1000) == 950
    assert layout.rows_per_block("scan_heavy", 0.1, 1000) == 500
    assert layout.rows_per_block("analytical", None, 10) == 16


def test_bulk_load_dedup(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 1, 2), (2, 1, 1, 3)], "a long, b long, m long, value long")
    assert layout.bulk_load(rows, TINY, str(tmp_path / "x"), dedup=True).rows.orderBy("value").select("value").collect() == [(2,), (3,)]
    assert layout.bulk_load(rows, TINY, str(tmp_path / "y")).count() == 3


def test_delete_one_occurrence(spark):
    rows = spark.createDataFrame([(5, 1), (5, 2), (5, 3), (6, 4)], "key long, value long")
    keys = spark.createDataFrame([(5,), (5,), (7,)], "dk long")
    assert sorted(r["value"] for r in mutations.remove_one_each(rows, keys).collect()) == [3, 4]


def test_mutable_cube(spark, tmp_path):
    s = sales_schema()
    base = generate(spark, "uniform", 200, partitions=2)
    cube = mutations.MutableCube(layout.bulk_load(base, s, str(tmp_path / "c")))
    new = generate(spark, "clustered", 50, seed=7, partitions=2).withColumn("value", F.col("value") + 1000)
    cube.insert(new)
    assert cube.count() == 250
    assert cube.stats.agg(F.sum("n")).first()[0] == 250
    key = base.orderBy("value").first()["key"]
    assert cube.remove(spark.createDataFrame([(key,)], "dk long")) == 1
    assert cube.remove(spark.createDataFrame([(-1,)], "dk long")) == 0
    moved = cube.rows.filter("value = 1001").select(*s.names, "value").withColumn("year", F.lit(200).cast("long")).withColumn("new_value", F.lit(5000).cast("long"))
    cube.update(moved)
    assert cube.count() == 249
    assert cube.rows.filter("year = 200").select("value").collect() == [(5000,)]
    packed = cube.compact(str(tmp_path / "d"))
    assert packed.count() == 249 and packed.cube.count() == 249


def test_transactions(spark):
    base = spark.createDataFrame([(1, 10), (2, 20)], "key long, value long")
    log = txn.Log(spark)
    assert log.recover() == {"committed_txns": 0, "redo_records": 0}
    t = log.begin()
    t.insert(spark.createDataFrame([(3, 30)], "key long, value long"))
    t.delete(base.filter("value = 10"))
    assert t.commit() == 1
    dropped = log.begin()
    dropped.insert(base)
    dropped.abort()
    t = log.begin()
    t.insert(spark.createDataFrame([(4, 40)], "key long, value long"))
    assert t.commit() == 2
    versions = log.versions(base)
    see = lambda e: sorted(r["value"] for r in txn.snapshot(versions, e).collect())
    assert (see(0), see(1), see(2)) == ([10, 20], [20, 30], [20, 30, 40])
    assert txn.Log(spark, log.path).recover() == {"committed_txns": 2, "redo_records": 3}
    assert sorted(r["value"] for r in log.checkpoint(base).collect()) == [20, 30, 40]


@pytest.mark.parametrize("distribution", DISTRIBUTIONS)
def test_generators_fit_the_schema(spark, distribution):
    s = sales_schema()
    rows = generate(spark, distribution, 2000, partitions=3)
    assert rows.count() == 2000
    bounds = rows.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in s.names for f in (F.min, F.max)]).first()
    assert all(0 <= bounds[f"min_{n}"] and bounds[f"max_{n}"] <= s.dim(n).max_code for n in s.names)
    assert rows.select(F.bit_xor("key")).first() == generate(spark, distribution, 2000, partitions=3).select(F.bit_xor("key")).first()


def test_betas(cube, spark):
    b = spark.createDataFrame([(0, 0), (5, 5), (1, 3), (0, 3)], "lo long, hi long").select(stats.beta(F.col("lo"), F.col("hi")))
    assert [r[0] for r in b.collect()] == [0.0, 0.0, 4 / 12, float("inf")]
    betas = stats.block_betas(cube.stats)
    assert betas.count() == cube.stats.count()
    keys = spark.createDataFrame([(x,) for x in (100, 200, 300, 400, 1000)], "key long")
    got = {s: stats.beta_threshold(keys, s, 0.5) for s in stats.STRATEGIES}
    spread = (sum((x - 400) ** 2 for x in (100, 200, 300, 400, 1000)) / 5) ** 0.5
    want = {"fixed_strict": 0.5, "adaptive_local": 0.0, "arithmetic_mean": 0.1 * 900**2 / (4 * 100 * 1000), "median": 0.3, "stddev_2x": 2 * spread, "stddev_6x": 6 * spread}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert all(stats.beta_threshold(keys.filter("false"), s, 0.5) == (0.0 if s == "adaptive_local" else 0.5) for s in want)
    assert stats.statistics(cube).first()["records"] == 3400
    h = stats.histogram(cube.rows, "m", 4).orderBy("bucket").collect()
    assert sum(r["n"] for r in h) == 3400 and all(x["hi"] < y["lo"] for x, y in zip(h, h[1:], strict=False))
    assert stats.approximate_histogram(cube.rows, ["a", "m"]).count() == 2


def test_ties_in_top_groups(spark):
    from cubewright.operators.aggregates import top_groups

    rows = spark.createDataFrame([(3, 5), (1, 5), (2, 9), (4, 1)], "g long, v long")
    assert [r["g"] for r in top_groups(rows, "g", "v", 2).collect()] == [2, 1]


def test_null_groups_have_averages(spark):
    rows = spark.createDataFrame([(None, 1), (None, 5), (1, 2)], "g long, v long")
    assert [r["v"] for r in analytics.above_group_average(rows, ["g"], "v").collect()] == [5]


def test_range_aggregate_reads_edge_blocks_alone(cube):
    """The scan opens the files of the blocks that cross the range's ends, no other."""
    from cubewright.plans import planner

    blocks = cube.stats.orderBy("key_lo").collect()
    assert len(blocks) >= 4
    low, high = blocks[1]["key_lo"] + 1, blocks[-2]["key_hi"] - 1
    edge = {b["file"] for b in blocks if b["key_hi"] >= low and b["key_lo"] <= high and not (b["key_lo"] >= low and b["key_hi"] <= high)}
    found = planner.range_aggregate(cube, "m", low, high)
    assert {f.rsplit("/", 1)[-1] for f in found.inputFiles()} == {f.rsplit("/", 1)[-1] for f in edge} and len(edge) < len(blocks) - 1
    want = cube.rows.filter(F.col("key").between(low, high)).agg(F.count("*"), F.sum("m")).first()
    assert tuple(found.first()) == tuple(want)
    assert tuple(planner.range_aggregate(cube, "m", high, low).first()) == (0, 0)
