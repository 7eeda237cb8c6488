"""Queries answered from block statistics where these suffice, from a pruned scan elsewhere."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import KeyRange, PredicateSet
from .layout import Cube, sidecar

#: A block list is used if it skips more than this share of the rows; else all blocks are scanned under the plain filter.
WORTH = 0.25
#: Block numbers that go into a scan's filter at most; a longer list becomes a join.
LISTED = 1000


@dataclass(frozen=True)
class Plan:
    """What a query touches: blocks answered by statistics, scanned and skipped, and the strategy."""

    strategy: str
    contained: int
    scanned: int
    skipped: int
    estimated_rows: int


def _sum_up(cube: Cube, touched: DataFrame, inside, dim: str, where) -> DataFrame | None:
    """(n, s) from a local sidecar: blocks that are ``inside`` by their statistics, the others by a scan of their files alone."""
    got = touched.select("n", F.col(f"sum_{dim}").alias("s"), "file", F.coalesce(inside, F.lit(False)).alias("inside")).collect()
    edge = [r["file"] for r in got if not r["inside"]]
    if len(edge) > LISTED:
        return None
    n, s = (sum(r[c] or 0 for r in got if r["inside"]) for c in ("n", "s"))
    known = [F.lit(n).cast("long").alias("n"), F.lit(s).cast("long").alias("s")]
    if not edge:
        return cube.spark.range(1).select(*known)
    scanned = cube.blocks(edge).filter(where).agg(F.count("*").alias("n"), F.coalesce(F.sum(dim), F.lit(0)).alias("s"))
    return scanned.select((F.col("n") + n).cast("long").alias("n"), (F.col("s") + s).cast("long").alias("s"))


def _sum_up_joined(cube: Cube, touched: DataFrame, inside, dim: str, where) -> DataFrame:
    """The same where the statistics are a table of many blocks."""
    known = touched.filter(inside).agg(F.sum("n").alias("n"), F.sum(f"sum_{dim}").alias("s"))
    edge = touched.filter(~F.coalesce(inside, F.lit(False))).select("block_id")
    scanned = cube.rows.filter(where).join(edge, "block_id", "left_semi").agg(F.count("*").alias("n"), F.sum(dim).alias("s"))
    return known.unionByName(scanned).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("s"))


def range_aggregate(cube: Cube, dim: str, low: int, high: int) -> DataFrame:
    """One row (n, s): COUNT and SUM of a dimension's codes over keys in [low, high].

    Blocks inside the range are answered by the sidecar. At most two blocks cross its ends (more only if a key fills several),
    and only their files are read. ``low > high``: zeros.
    """
    inside = (F.col("key_lo") >= low) & (F.col("key_hi") <= high)
    touched = (F.col("key_hi") >= low) & (F.col("key_lo") <= high) & F.lit(low <= high)
    where, local = F.col("key").between(low, high), sidecar(cube)
    found = _sum_up(cube, local.filter(touched), inside, dim, where) if local is not None else None
    return _sum_up_joined(cube, cube.stats.filter(touched), inside, dim, where) if found is None else found


def _marked(cube: Cube, where: PredicateSet) -> list | None:
    """n, file, and whether the set may and must hold, of every block of a local sidecar; no job runs."""
    local = sidecar(cube)
    if local is None:
        return None
    return local.select("n", "file", F.coalesce(where.may_hold(), F.lit(False)).alias("may"), F.coalesce(where.must_hold(), F.lit(False)).alias("must")).collect()


def plan(cube: Cube, where: PredicateSet, worth: float = WORTH) -> Plan:
    """Count what the statistics say about a predicate set."""
    return _plan(cube, where, worth, _marked(cube, where))


def _plan(cube: Cube, where: PredicateSet, worth: float, got: list | None) -> Plan:
    if got is not None:
        r = {"rows": sum(x["n"] for x in got), "blocks": len(got), "left": sum(x["n"] for x in got if x["may"])}
        r |= {"contained": sum(x["may"] and x["must"] for x in got), "scanned": sum(x["may"] and not x["must"] for x in got)}
    else:
        may, must = where.may_hold(), where.must_hold()
        r = cube.stats.agg(
            F.sum("n").alias("rows"), F.count("*").alias("blocks"),
            F.count_if(may & must).alias("contained"), F.count_if(may & ~must).alias("scanned"), F.sum(F.when(may, F.col("n")).otherwise(0)).alias("left")).first()
    rows, left = r["rows"] or 0, r["left"] or 0
    useful = rows > 0 and (rows - left) > worth * rows
    return Plan("blocks" if useful else "scan", r["contained"], r["scanned"], r["blocks"] - r["contained"] - r["scanned"], left)


def search(cube: Cube, where: PredicateSet, worth: float = WORTH) -> DataFrame:
    """Rows that satisfy the set: from listed blocks if the statistics skip enough, else by a filtered scan of all."""
    rows = cube.rows.filter(where.column(cube.schema))
    got = _marked(cube, where)
    p = _plan(cube, where, worth, got)
    if p.strategy == "scan":
        return rows
    if got is not None and p.contained + p.scanned <= LISTED:
        return cube.blocks([r["file"] for r in got if r["may"]]).filter(where.column(cube.schema))
    return rows.join(cube.stats.filter(where.may_hold()).select("block_id"), "block_id", "left_semi")


def filtered_aggregate(cube: Cube, where: PredicateSet, dim: str) -> DataFrame:
    """One row (n, s): COUNT and SUM under a predicate set; wholly satisfied blocks are answered by the sidecar."""
    may, must, local = where.may_hold(), where.must_hold(), sidecar(cube)
    found = _sum_up(cube, local.filter(may), must, dim, where.column(cube.schema)) if local is not None else None
    return _sum_up_joined(cube, cube.stats.filter(may), must, dim, where.column(cube.schema)) if found is None else found


def estimate_cost(cube: Cube, where: PredicateSet) -> dict:
    """Estimated rows, total cost (rows to be tested plus blocks opened) and whether a scan of all is advised."""
    p = plan(cube, where)
    total = cube.count()
    return {"estimated_rows": p.estimated_rows, "total_cost": p.estimated_rows + 1000 * (p.contained + p.scanned), "recommend_seq_scan": p.strategy == "scan", "rows": total}


def key_range(cube: Cube, where: PredicateSet) -> KeyRange:
    return KeyRange(*where.key_range(cube.schema))
