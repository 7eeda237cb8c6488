"""All queries of the analytics engine, by name, each with the SQL that says the same.

They run on the bulk-loaded cube of the tables in a directory (see ``sources.cube``); codes of years 1996 to 1999 are 6 to 9.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.checksum import group_term
from .functions.predicates import Predicate, PredicateSet, any_of, between, eq, isin
from .functions.schema import CubeSchema, Dimension
from .operators import aggregates, analytics, mutations, scan, txn
from .plans import layout, planner, stats
from .sources.cube import SCHEMA, cube_view, stored_cube
from .sources.generators import generate
from .streaming.append import windowed_sums

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The cube in SQL; every statement below reads it.
CUBE = """
SELECT *, year * 9007199254740992 + month * 562949953421312 + day * 17592186044416 + state * 549755813888 + product * 17179869184 + price * 1024 + version AS key
FROM (
  SELECT cast(year(l_shipdate) AS bigint) - 1990 AS year, cast(month(l_shipdate) AS bigint) - 1 AS month, cast(day(l_shipdate) AS bigint) - 1 AS day,
    cast(c_nationkey AS bigint) AS state, cast(substr(p_brand, 7) AS bigint) AS product, cast(floor(l_extendedprice * 100) AS bigint) AS price,
    cast(floor(l_discount * 100) AS bigint) AS version, cast(l_orderkey * 8 + l_linenumber AS bigint) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)
"""


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH cube AS ({CUBE}) {sql}"
        return f

    return register


def _rows(spark, d) -> DataFrame:
    return stored_cube(spark, d).rows


def _found(rows: DataFrame) -> DataFrame:
    """What a selection is compared by: count, sum of prices, XOR of keys."""
    return rows.agg(F.count("*").alias("n"), F.sum("price").cast("long").alias("sp"), F.bit_xor("key").alias("chk"))


_FOUND = "SELECT count(*) n, cast(sum(price) AS bigint) sp, bit_xor(key) chk FROM cube"
YEAR, MONTH, STATE = 9007199254740992, 562949953421312, 549755813888
NARROW = (8 * YEAR + 5 * MONTH, 8 * YEAR + 6 * MONTH - 1)


# scans and cursors


@query("scan_checksum", _FOUND)
def _(spark, d):
    return _found(_rows(spark, d))


@query("bulk_load", "SELECT count(*) n, cast(count(*) AS bigint) total, bit_xor(key) chk, cast(min(key) AS bigint) lo, cast(max(key) AS bigint) hi FROM cube")
def _(spark, d):
    cube = stored_cube(spark, d)
    sizes = cube.stats.agg(F.sum("n").alias("n"), F.min("key_lo").alias("lo"), F.max("key_hi").alias("hi"))
    return sizes.crossJoin(F.broadcast(cube.rows.agg(F.count("*").alias("total"), F.bit_xor("key").alias("chk")))).select("n", "total", "chk", "lo", "hi")  # one row each


@query("point_lookup", "SELECT count(*) n, bit_xor(c.key) chk FROM cube c JOIN (SELECT key pk FROM cube WHERE value % 97 = 0) p ON c.key = p.pk")
def _(spark, d):
    rows = _rows(spark, d)
    return scan.checksum(scan.point_lookup(rows.select("key"), rows.filter("value % 97 = 0").select(F.col("key").alias("pk"))))


@query("point_search", "SELECT key, value FROM cube WHERE key = (SELECT min(key) FROM cube WHERE year = 8)")
def _(spark, d):
    rows = _rows(spark, d)
    least = rows.filter("year = 8").agg(F.min("key").alias("pk"))
    return scan.point_lookup(rows.select("key", "value"), least)


@query("range_narrow", f"{_FOUND} WHERE key BETWEEN {NARROW[0]} AND {NARROW[1]}")
def _(spark, d):
    return _found(scan.range_search(_rows(spark, d), *NARROW))


@query("range_wide", f"{_FOUND} WHERE year BETWEEN 6 AND 9")
def _(spark, d):
    where = PredicateSet.of(between("year", 6, 9))
    return _found(scan.range_search(_rows(spark, d), *where.key_range(SCHEMA)))


@query("range_empty", f"SELECT count(*) n, coalesce(cast(sum(price) AS bigint), 0) s FROM cube WHERE key BETWEEN {NARROW[1]} AND {NARROW[0]}")
def _(spark, d):
    return planner.range_aggregate(stored_cube(spark, d), "price", NARROW[1], NARROW[0])


@query("lower_bound_first", f"SELECT key, value FROM cube WHERE key >= {8 * YEAR} ORDER BY key, value LIMIT 10")
def _(spark, d):
    return scan.lower_bound(_rows(spark, d), 8 * YEAR).select("key", "value").limit(10)


@query("upper_bound_first", f"SELECT key, value FROM cube WHERE key > {8 * YEAR + 3 * MONTH} ORDER BY key, value LIMIT 10")
def _(spark, d):
    return scan.upper_bound(_rows(spark, d), 8 * YEAR + 3 * MONTH).select("key", "value").limit(10)


@query("reverse_top", "SELECT key, value FROM cube ORDER BY key DESC, value DESC LIMIT 10")
def _(spark, d):
    return scan.ordered(_rows(spark, d), descending=True).select("key", "value").limit(10)


@query("cursor_range", f"SELECT key, value FROM cube WHERE key BETWEEN {NARROW[0]} AND {NARROW[1]}")
def _(spark, d):
    return scan.ordered(scan.range_search(_rows(spark, d), *NARROW)).select("key", "value")


# predicates

_PREDICATES = {
    "pred_eq": (eq("year", 8), "year = 8"),
    "pred_neq": (Predicate("product", "neq", (5,)), "product <> 5"),
    "pred_lt": (Predicate("price", "lt", (1000000,)), "price < 1000000"),
    "pred_lte": (Predicate("day", "lte", (9,)), "day <= 9"),
    "pred_gt": (Predicate("price", "gt", (6000000,)), "price > 6000000"),
    "pred_gte": (Predicate("year", "gte", (9,)), "year >= 9"),
    "pred_between": (between("month", 3, 6), "month BETWEEN 3 AND 6"),
    "pred_in": (isin("state", 1, 5, 9), "state IN (1, 5, 9)"),
    "pred_not_null": (Predicate("version", "is_not_null"), "version IS NOT NULL"),
}
for _name, (_p, _sql) in _PREDICATES.items():
    query(_name, f"{_FOUND} WHERE {_sql}")(lambda spark, d, p=_p: _found(planner.search(stored_cube(spark, d), PredicateSet.of(p))))


@query("pred_null", "SELECT count(*) n, cast(sum(price) AS bigint) sp, bit_xor(value) chk FROM (SELECT CASE WHEN version % 7 <> 0 THEN version END v, price, value FROM cube) t WHERE v IS NULL")
def _(spark, d):
    rows = _rows(spark, d).withColumn("v", F.when(F.col("version") % 7 != 0, F.col("version")))
    return rows.filter(Predicate("v", "is_null").column()).agg(F.count("*").alias("n"), F.sum("price").cast("long").alias("sp"), F.bit_xor("value").alias("chk"))


@query("pred_like", "SELECT count(*) n, cast(sum(price) AS bigint) sp, bit_xor(key) chk FROM cube JOIN nation ON state = n_nationkey WHERE n_name LIKE '%A%1'")
def _(spark, d):
    names = dict(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").limit(1 << 5).collect())  # a dictionary of at most 2**5 codes
    labels = tuple(names.get(i, "") for i in range(max(names, default=-1) + 1))
    dims = tuple(replace(x, labels=labels) if x.name == "state" else x for x in SCHEMA.dims)
    cube = replace(stored_cube(spark, d), schema=CubeSchema(dims))
    return _found(planner.search(cube, PredicateSet.of(Predicate("state", "like", ("%A%1",)))))


@query("pred_not", f"{_FOUND} WHERE NOT (year = 8 AND state = 1)")
def _(spark, d):
    return _found(_rows(spark, d).filter(~PredicateSet.of(eq("year", 8), eq("state", 1)).column()))


@query("pred_empty_set", _FOUND)
def _(spark, d):
    return _found(planner.search(stored_cube(spark, d), PredicateSet()))


@query("pred_or_union", f"{_FOUND} WHERE (year = 8 AND state = 1) OR (year = 6 AND state = 9) OR (year = 9 AND product = 5)")
def _(spark, d):
    sets = [PredicateSet.of(eq("year", 8), eq("state", 1)), PredicateSet.of(eq("year", 6), eq("state", 9)), PredicateSet.of(eq("year", 9), eq("product", 5))]
    return _found(_rows(spark, d).filter(any_of(sets)))


@query("multi_dim", f"{_FOUND} WHERE year = 8 AND state = 1")
def _(spark, d):
    return _found(planner.search(stored_cube(spark, d), PredicateSet.of(eq("year", 8), eq("state", 1))))


@query("hypercube", f"{_FOUND} WHERE year BETWEEN 6 AND 9 AND state BETWEEN 1 AND 3 AND product = 5")
def _(spark, d):
    return _found(planner.search(stored_cube(spark, d), PredicateSet.of(between("year", 6, 9), between("state", 1, 3), eq("product", 5))))


@query("hyperbox4", f"{_FOUND} WHERE year BETWEEN 7 AND 9 AND state BETWEEN 1 AND 5 AND product BETWEEN 5 AND 7 AND price BETWEEN 1000000 AND 6000000")
def _(spark, d):
    box = PredicateSet.of(between("year", 7, 9), between("state", 1, 5), between("product", 5, 7), between("price", 1000000, 6000000))
    return _found(planner.search(stored_cube(spark, d), box))


@query("count_predicate", "SELECT count(*) n FROM cube WHERE year = 8 AND product IN (1, 2, 3)")
def _(spark, d):
    return planner.search(stored_cube(spark, d), PredicateSet.of(eq("year", 8), isin("product", 1, 2, 3))).agg(F.count("*").alias("n"))


# keys


@query("encode_key", "SELECT key, value FROM cube WHERE month = 0")
def _(spark, d):
    return cube_view(spark, d).filter("month = 0").select("key", "value")


@query("decode_key", "SELECT value, year + 1990 AS year, month + 1 AS month, day + 1 AS day, price / 100.0 AS price FROM cube WHERE state = 3")
def _(spark, d):
    dims = SCHEMA.dim
    rows = _rows(spark, d).filter("state = 3")
    return rows.select("value", *[dims(n).decode_int(SCHEMA.extract(n)).alias(n) for n in ("year", "month", "day")], dims("price").decode_float(SCHEMA.extract("price")).alias("price"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")  # a fifth one is left out, to be unknown


@query("string_dictionary", f"""SELECT code, zero_code, CASE WHEN code IS NOT NULL THEN c_mktsegment END AS label, n FROM (
  SELECT c_mktsegment, count(*) n, cast(nullif(list_position({list(_SEGMENTS)}, c_mktsegment), 0) - 1 AS bigint) code, cast(greatest(coalesce(list_position({list(_SEGMENTS)}, c_mktsegment), 0) - 1, 0) AS bigint) zero_code
  FROM customer GROUP BY c_mktsegment)""")  # fmt: skip
def _(spark, d):
    """Labels to codes and back; an unknown label is NULL, or 0 where a store has no other answer."""
    dim = Dimension("segment", 5, labels=_SEGMENTS)
    by = spark.read.parquet(f"{d}/customer.parquet").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    codes = by.select(dim.encode_string(F.col("c_mktsegment")).alias("code"), dim.encode_string(F.col("c_mktsegment"), True).alias("zero_code"), "n")
    return codes.withColumn("label", dim.decode_string(F.col("code")))


@query("group_checksum", """SELECT CASE WHEN x >= 9223372036854775808 THEN cast(cast(x AS hugeint) - 18446744073709551616 AS bigint) ELSE cast(x AS bigint) END chk FROM (
  SELECT bit_xor(xor(cast((cast(state AS hugeint) * 11400714819323198485) % 18446744073709551616 AS ubigint), cast(sp AS ubigint))) x FROM (SELECT state, sum(price) sp FROM cube GROUP BY state))""")  # fmt: skip
def _(spark, d):
    sums = _rows(spark, d).groupBy("state").agg(F.sum("price").alias("sp"))
    return sums.agg(F.bit_xor(group_term("state", "sp")).alias("chk"))


@query("extract_dim", "SELECT state, product, count(*) n FROM cube GROUP BY state, product")
def _(spark, d):
    rows = _rows(spark, d).select(SCHEMA.extract("state").alias("state"), SCHEMA.extract("product").alias("product"))
    return aggregates.group_count(rows, "state", "product")


# aggregates

_WIDE = PredicateSet.of(between("year", 6, 9)).key_range(SCHEMA)
_AGG_RANGE = "SELECT count(*) n, coalesce(cast(sum(price) AS bigint), 0) s FROM cube WHERE year BETWEEN 6 AND 9"


@query("agg_range", _AGG_RANGE)
def _(spark, d):
    return aggregates.aggregate_dim(_rows(spark, d), "price", *_WIDE).drop("a")


@query("agg_range_sidecar", _AGG_RANGE)
def _(spark, d):
    return planner.range_aggregate(stored_cube(spark, d), "price", *_WIDE)


@query("agg_dim_sidecar", "SELECT count(*) n, coalesce(cast(sum(price) AS bigint), 0) s FROM cube WHERE year = 8 AND month BETWEEN 2 AND 9")
def _(spark, d):
    return planner.filtered_aggregate(stored_cube(spark, d), PredicateSet.of(eq("year", 8), between("month", 2, 9)), "price")


@query("agg_all_avg", "SELECT count(*) n, cast(sum(price) AS bigint) s, cast(sum(price) AS double) / count(*) a FROM cube")
def _(spark, d):
    return aggregates.aggregate_dim(_rows(spark, d), "price")


@query("group_count", "SELECT state, count(*) n FROM cube GROUP BY state")
def _(spark, d):
    return aggregates.group_count(_rows(spark, d), "state")


@query("group_sum", "SELECT state, count(*) n, cast(sum(price) AS bigint) sp FROM cube WHERE year = 8 GROUP BY state")
def _(spark, d):
    return aggregates.group_sum(_rows(spark, d).filter("year = 8"), ["state"], "price")


@query("group_composite", "SELECT state, product, count(*) n, cast(sum(price) AS bigint) sp FROM cube GROUP BY state, product")
def _(spark, d):
    return aggregates.group_sum(_rows(spark, d), ["state", "product"], "price")


@query("group_distinct", "SELECT count(DISTINCT year) d_year, count(DISTINCT state) d_state, count(DISTINCT product) d_product FROM cube")
def _(spark, d):
    return aggregates.distinct_codes(_rows(spark, d), ["year", "state", "product"])


@query("having", "SELECT state, cast(sum(price) AS bigint) sp FROM cube GROUP BY state HAVING sum(price) * 25 > (SELECT sum(price) FROM cube)")
def _(spark, d):
    return aggregates.having_above_share(_rows(spark, d), "state", "price", 25)


@query("having_fixed", "SELECT state, cast(sum(price) AS bigint) sp FROM cube GROUP BY state HAVING sum(price) > 8000000000")
def _(spark, d):
    return aggregates.having_above(_rows(spark, d), "state", "price", 8000000000)


@query("rollup_ym", "SELECT year, month, cast(count(*) AS bigint) n, cast(sum(price) AS bigint) sp FROM cube WHERE year BETWEEN 6 AND 9 GROUP BY GROUPING SETS ((year, month), (year))")
def _(spark, d):
    return aggregates.rollup_two(_rows(spark, d).filter("year between 6 and 9"), "year", "month", "price")


@query("topk_groups", "SELECT product, cast(sum(price) AS bigint) sp FROM cube WHERE year = 8 GROUP BY product ORDER BY sp DESC, product LIMIT 5")
def _(spark, d):
    return aggregates.top_groups(_rows(spark, d).filter("year = 8"), "product", "price", 5)


@query("dim_stats", " UNION ALL ".join(f"SELECT '{c}' dim, count({c}) n, cast(sum({c}) AS bigint) s, min({c}) lo, max({c}) hi, count(DISTINCT {c}) distinct_count FROM cube" for c in ("year", "month", "state", "product")))
def _(spark, d):
    return stats.dim_stats(_rows(spark, d), ["year", "month", "state", "product"])


@query("dim_stats_sidecar", "SELECT min(year) min_year, max(year) max_year, cast(sum(price) AS bigint) sum_price, min(price) min_price, max(price) max_price, count(*) n FROM cube")
def _(spark, d):
    whole = layout.merge_stats(stored_cube(spark, d).stats, SCHEMA)
    return whole.select("min_year", "max_year", "sum_price", "min_price", "max_price", "n")


@query("histogram", """SELECT cast(floor((upto - c) * 8 / total) AS bigint) bucket, min(code) lo, max(code) hi, cast(sum(c) AS bigint) n FROM (
  SELECT code, c, sum(c) OVER (ORDER BY code) upto, sum(c) OVER () total FROM (SELECT price // 100000 code, count(*) c FROM cube GROUP BY 1)) GROUP BY 1""")
def _(spark, d):
    return stats.histogram(_rows(spark, d).select(F.expr("price div 100000").alias("price")), "price", 8)


# correlated, joins and windows


@query("corr_product", "SELECT count(*) n, cast(sum(price) AS bigint) sp, bit_xor(key) chk FROM (SELECT key, price, avg(price) OVER (PARTITION BY product) a FROM cube) t WHERE price > a")
def _(spark, d):
    return _found(analytics.above_group_average(_rows(spark, d), ["product"], "price"))


@query("corr_state_product", "SELECT count(*) n, cast(sum(price) AS bigint) sp, bit_xor(key) chk FROM (SELECT key, price, avg(price) OVER (PARTITION BY state, product) a FROM cube) t WHERE price > a")
def _(spark, d):
    return _found(analytics.above_group_average(_rows(spark, d), ["state", "product"], "price"))


@query("moving_window", "SELECT w.m0, count(*) n, cast(sum(c.price) AS bigint) sp FROM cube c JOIN (SELECT DISTINCT month m0 FROM cube WHERE month <= 9) w ON c.month BETWEEN w.m0 AND w.m0 + 2 WHERE c.year = 8 GROUP BY w.m0")
def _(spark, d):
    return analytics.moving_windows(_rows(spark, d).filter("year = 8"), "month", "price", 3, 9)


@query("moving_window_centered", "SELECT w.m0 AS month, count(*) n, cast(sum(c.price) AS bigint) sp FROM cube c JOIN (SELECT DISTINCT month m0 FROM cube WHERE year = 8) w ON c.month BETWEEN w.m0 - 1 AND w.m0 + 1 WHERE c.year = 8 GROUP BY w.m0")
def _(spark, d):
    return analytics.centred_windows(_rows(spark, d).filter("year = 8"), "month", "price").select("month", F.col("n").cast("long").alias("n"), "sp")


@query("top3_per_month", "SELECT month, state, sp FROM (SELECT month, state, sp, row_number() OVER (PARTITION BY month ORDER BY sp DESC, state) rn FROM (SELECT month, state, cast(sum(price) AS bigint) sp FROM cube WHERE year = 8 GROUP BY month, state) g) r WHERE rn <= 3")
def _(spark, d):
    return aggregates.top_per(_rows(spark, d).filter("year = 8"), "month", "state", "price", 3)


@query("yoy_left", "SELECT b.product, cast(b.s - coalesce(a.s, 0) AS bigint) d FROM (SELECT product, sum(price) s FROM cube WHERE year = 8 GROUP BY product) b LEFT JOIN (SELECT product, sum(price) s FROM cube WHERE year = 7 GROUP BY product) a ON a.product = b.product WHERE b.s > coalesce(a.s, 0)")
def _(spark, d):
    return analytics.growth(_rows(spark, d), ["product"], "price", "year", 8, 7)


@query("yoy_self_join", "SELECT b.state, b.product, cast(b.s - coalesce(a.s, 0) AS bigint) d FROM (SELECT state, product, sum(price) s FROM cube WHERE year = 8 GROUP BY state, product) b LEFT JOIN (SELECT state, product, sum(price) s FROM cube WHERE year = 7 GROUP BY state, product) a ON a.state = b.state AND a.product = b.product WHERE b.s * 5 > coalesce(a.s, 0) * 6")
def _(spark, d):
    return analytics.growth(_rows(spark, d), ["state", "product"], "price", "year", 8, 7, over=(5, 6))


@query("cte_join", "SELECT count(*) n, cast(sum(t.price) AS bigint) sp, bit_xor(t.key) chk FROM cube t JOIN (SELECT state, product, avg(price) ap FROM cube WHERE year = 7 GROUP BY state, product) a ON t.state = a.state AND t.product = a.product WHERE t.year = 8 AND t.price > a.ap")
def _(spark, d):
    rows = _rows(spark, d)
    return _found(analytics.above_reference_average(rows.filter("year = 8"), rows.filter("year = 7"), ["state", "product"], "price"))


@query("adhoc_drill", "SELECT cast(count(*) AS bigint) n FROM cube c JOIN (SELECT year dy, state ds FROM cube WHERE value % 1999 = 0) d ON c.year = d.dy AND c.state = d.ds")
def _(spark, d):
    rows = _rows(spark, d)
    wanted = rows.filter("value % 1999 = 0").select(F.col("year").alias("dy"), F.col("state").alias("ds"))
    return analytics.drill(rows.select("year", "state"), wanted, {"year": "dy", "state": "ds"}).agg(F.coalesce(F.sum("_times"), F.lit(0)).cast("long").alias("n"))


# changes

_INSERTED = "SELECT key, value FROM cube UNION ALL SELECT key + 1, value FROM cube WHERE value % 97 = 0"


@query("insert_view", f"SELECT count(*) n, bit_xor(key) chk FROM ({_INSERTED}) t")
def _(spark, d):
    rows = _rows(spark, d).select("key", "value")
    return scan.checksum(mutations.insert(rows, rows.filter("value % 97 = 0").select((F.col("key") + 1).alias("key"), "value")))


@query("delete_one_occurrence", "SELECT count(*) n, bit_xor(b.key) chk FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY value) rn FROM cube) b LEFT JOIN (SELECT key dk, count(*) dn FROM cube WHERE value % 101 = 0 GROUP BY key) d ON b.key = d.dk WHERE b.rn > coalesce(d.dn, 0)")
def _(spark, d):
    rows = _rows(spark, d).select("key", "value")
    return scan.checksum(mutations.remove_one_each(rows, rows.filter("value % 101 = 0").select(F.col("key").alias("dk"))))


@query("update_key", f"SELECT count(*) n, bit_xor(CASE WHEN value % 89 = 0 AND state < 24 THEN key + {STATE} ELSE key END) chk FROM cube")
def _(spark, d):
    rows = _rows(spark, d).drop("block_id")
    changes = rows.filter("value % 89 = 0 and state < 24").withColumn("state", F.col("state") + 1)
    return scan.checksum(mutations.update(rows, SCHEMA, changes, on="key"))


@query("snapshot_read", "SELECT count(*) n, bit_xor(key) chk FROM (SELECT key, value % 5 xmin, CASE WHEN value % 3 = 0 THEN value % 5 + 2 END xmax FROM cube) v WHERE xmin <= 3 AND (xmax IS NULL OR xmax > 3)")
def _(spark, d):
    rows = _rows(spark, d).select("key", (F.col("value") % 5).alias("xmin"), F.when(F.col("value") % 3 == 0, F.col("value") % 5 + 2).alias("xmax"))
    return scan.checksum(txn.snapshot(rows, 3))


@query("dedup_last_wins", "SELECT count(*) n, bit_xor(value) chk FROM (SELECT key, max(value) AS value FROM (SELECT year * 1000000 + month * 10000 + day * 100 + state AS key, value FROM cube) k GROUP BY key) t")
def _(spark, d):
    rows = _rows(spark, d).select((F.col("year") * 1000000 + F.col("month") * 10000 + F.col("day") * 100 + F.col("state")).alias("key"), "value")
    return mutations.dedup_last(rows).agg(F.count("*").alias("n"), F.bit_xor("value").alias("chk"))


@query("tombstones", "SELECT count(*) n, bit_xor(key) chk FROM cube WHERE value % 103 <> 0")
def _(spark, d):
    rows = _rows(spark, d).select("key", "value")
    return scan.checksum(mutations.live(rows, rows.filter("value % 103 = 0")))


@query("range_outside", f"{_FOUND} WHERE year < 0 OR year >= 300")
def _(spark, d):
    below, above = (PredicateSet.of(Predicate("year", op, (v,))).key_range(SCHEMA) for op, v in (("lt", 0), ("gte", 300)))
    rows = _rows(spark, d)
    return _found(scan.range_search(rows, *below).unionByName(scan.range_search(rows, *above)))


@query("remove_one_of_two_equal", "SELECT count(*) n, bit_xor(key) chk FROM (SELECT key FROM cube UNION ALL SELECT key FROM cube WHERE value % 97 = 0 AND value % 103 <> 0) t")
def _(spark, d):
    """Every 97th row is there twice; of those that are also a 103rd, one of the two goes."""
    rows = _rows(spark, d).select("key", "value")
    return scan.checksum(mutations.live(mutations.insert(rows, rows.filter("value % 97 = 0")), rows.filter("value % 97 = 0 and value % 103 = 0")))


@query("reinsert", "SELECT count(*) n, bit_xor(key) chk FROM cube WHERE value % 103 <> 0 OR value % 2 = 0")
def _(spark, d):
    """Every 103rd row is removed, and of those the even ones come back."""
    cube = mutations.MutableCube(stored_cube(spark, d))
    gone = cube.cube.rows.filter("value % 103 = 0")
    cube.remove(gone.select(F.col("key").alias("dk")))
    back = cube.cube.rows.filter("value % 103 = 0 and value % 2 = 0")
    cube.insert(back)
    return scan.checksum(cube.rows)


@query("recover_after_crash", "SELECT count(*) n, bit_xor(value) chk FROM cube WHERE value % 101 = 0 AND NOT (value % 2 = 0 AND value % 3 = 0)")
def _(spark, d):
    """Three commits and a crash: rows are made, the even ones deleted, and of those the ones not divisible by 3 made again."""
    rows = _rows(spark, d).filter("value % 101 = 0").select("key", "value")
    log = txn.Log(spark)
    for step, (op, part) in enumerate((("insert", "true"), ("delete", "value % 2 = 0"), ("insert", "value % 2 = 0 and value % 3 <> 0"))):
        if step == 1:  # a commit of another process that died half-way
            rows.withColumn("op", F.lit("insert")).write.parquet(f"{log.path}/epoch=2")
            jvm = spark.sparkContext._jvm
            mark = jvm.org.apache.hadoop.fs.Path(f"{log.path}/epoch=2/_SUCCESS")
            mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(mark, False)
        t = log.begin()
        getattr(t, op)(rows.filter(part))
        t.commit()
    live = txn.snapshot(txn.Log(spark, log.path).versions(), log.epochs()[-1])
    return live.agg(F.count("*").alias("n"), F.bit_xor("value").alias("chk"))


@query("delta_compact", "SELECT count(*) n, bit_xor(value) chk FROM (SELECT value FROM cube WHERE value % 103 <> 0 UNION ALL SELECT value + 1000000000 FROM cube WHERE value % 97 = 0) t")
def _(spark, d):
    cube = mutations.MutableCube(stored_cube(spark, d))
    rows = cube.cube.rows
    cube.remove(rows.filter("value % 103 = 0").select(F.col("key").alias("dk")))
    cube.insert(rows.filter("value % 97 = 0").withColumn("value", F.col("value") + 1000000000))
    return cube.compact().rows.agg(F.count("*").alias("n"), F.bit_xor("value").alias("chk"))


# block statistics


@query("beta_blocks", "SELECT state block_id, count(*) n, CASE WHEN min(key) = max(key) THEN 0.0 ELSE (max(key)::double - min(key)::double) * (max(key)::double - min(key)::double) / (4 * min(key)::double * max(key)::double) END beta FROM cube GROUP BY state")
def _(spark, d):
    by_state = layout.block_stats(_rows(spark, d).withColumn("block_id", F.col("state")), SCHEMA)
    return stats.block_betas(by_state).select("block_id", "n", "beta")


@query("beta_thresholds", f"""SELECT strategy, round(ln(threshold), 9) ln_threshold FROM (SELECT unnest([
    {{'strategy': 'arithmetic_mean', 'threshold': greatest(0.1 * (hi - lo) * (hi - lo) / (4 * lo * hi), {stats.LEAST_THRESHOLD!r})}},
    {{'strategy': 'median', 'threshold': greatest(0.001 * middle, {stats.LEAST_THRESHOLD!r})}},
    {{'strategy': 'stddev_2x', 'threshold': greatest(2 * spread, {stats.LEAST_THRESHOLD!r})}},
    {{'strategy': 'stddev_6x', 'threshold': greatest(6 * spread, {stats.LEAST_THRESHOLD!r})}},
    {{'strategy': 'fixed_strict', 'threshold': 1e-6}}], recursive := true)
  FROM (SELECT min(k) lo, max(k) hi, quantile_disc(k, 0.5) middle, stddev_pop(k) spread FROM (SELECT key::double k FROM cube)))""")  # fmt: skip
def _(spark, d):
    """Logarithms of the bounds; ``adaptive_local`` has the bound 0 and no logarithm."""
    rows = _rows(spark, d)
    bounds = [(name, stats.beta_threshold(rows, name)) for name in stats.STRATEGIES if name != "adaptive_local"]
    return spark.createDataFrame(bounds, "strategy string, threshold double").select("strategy", F.round(F.ln("threshold"), 9).alias("ln_threshold"))


@query("statistics", None)
def _(spark, d):
    return stats.statistics(stored_cube(spark, d))


@query("cost_estimate", None)
def _(spark, d):
    return spark.createDataFrame([planner.estimate_cost(stored_cube(spark, d), PredicateSet.of(eq("year", 8), eq("month", 3)))])


# streams and generated data

@query(
    "event_windows",
    """SELECT window_start, event_type, count(*) n, cast(sum(cast(floor(value * 100) AS bigint)) AS bigint) cents FROM (
  SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY]) window_start FROM events) GROUP BY ALL""",
)
def _(spark, d):
    return windowed_sums(spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type", "value"))


#: The sequential distribution is arithmetic; the others are drawn.
_SEQUENTIAL = "SELECT i % 85680 // 336 AS year, count(*) n, cast(sum(50000 + i % 100000) AS bigint) sp FROM (SELECT unnest(range(100000)) i) GROUP BY 1"
for _name in ("uniform", "clustered", "skewed", "sequential"):
    query(f"generate_{_name}", _SEQUENTIAL if _name == "sequential" else None)(lambda spark, d, name=_name: aggregates.group_sum(generate(spark, name, 100_000, partitions=8), ["year"], "price"))
