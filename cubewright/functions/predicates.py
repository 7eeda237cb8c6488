"""Predicates on encoded dimensions, as columns for rows and as tests on block statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import CubeSchema

OPS = ("eq", "neq", "lt", "lte", "gt", "gte", "between", "in", "is_null", "is_not_null", "like")


@dataclass(frozen=True)
class Predicate:
    """A comparison of one dimension's code. ``like`` compares a dictionary's label. NULL satisfies only ``is_null``."""

    dim: str
    op: str
    args: tuple = ()

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op}")

    def column(self, schema: CubeSchema | None = None) -> Column:
        c = F.col(self.dim)
        match self.op, self.args:
            case "eq", (v,):
                return c == v
            case "neq", (v,):
                return c != v
            case "lt", (v,):
                return c < v
            case "lte", (v,):
                return c <= v
            case "gt", (v,):
                return c > v
            case "gte", (v,):
                return c >= v
            case "between", (lo, hi):
                return c.between(lo, hi)
            case "in", values:
                return c.isin(*values)
            case "is_null", _:
                return c.isNull()
            case "is_not_null", _:
                return c.isNotNull()
            case "like", (pattern,):
                labels = schema.dim(self.dim) if schema else None
                return (labels.decode_string(c) if labels and labels.labels else c.cast("string")).like(pattern)
        raise ValueError(f"{self.op} does not take {self.args}")

    def _bounds(self) -> tuple[int | None, int | None] | None:
        """The closed interval of codes that can satisfy the predicate (None: open); None if there is no such interval."""
        match self.op, self.args:
            case "eq", (v,):
                return v, v
            case "lt", (v,):
                return None, v - 1
            case "lte", (v,):
                return None, v
            case "gt", (v,):
                return v + 1, None
            case "gte", (v,):
                return v, None
            case "between", (lo, hi):
                return lo, hi
            case "in", values if values:
                return min(values), max(values)
        return None

    def may_hold(self) -> Column:
        """On a block's columns min_/max_/nulls_/n: whether some row can satisfy the predicate."""
        lo, hi, nulls = F.col(f"min_{self.dim}"), F.col(f"max_{self.dim}"), F.col(f"nulls_{self.dim}")
        if self.op == "is_null":
            return nulls > 0
        if self.op == "is_not_null":
            return nulls < F.col("n")
        some = lo.isNotNull()
        if self.op == "in" and self.args:
            return some & reduce(lambda x, y: x | y, [(lo <= v) & (hi >= v) for v in self.args])
        if self.op == "neq":
            return some & ~((lo == self.args[0]) & (hi == self.args[0]))
        if (bounds := self._bounds()) is None:
            return some
        if bounds[0] is not None:
            some = some & (hi >= bounds[0])
        return some & (lo <= bounds[1]) if bounds[1] is not None else some

    def must_hold(self) -> Column:
        """On a block's columns: whether every row satisfies the predicate."""
        lo, hi, nulls = F.col(f"min_{self.dim}"), F.col(f"max_{self.dim}"), F.col(f"nulls_{self.dim}")
        full = nulls == 0
        if self.op == "is_null":
            return nulls == F.col("n")
        if self.op == "is_not_null":
            return full
        if self.op == "in":
            return full & (lo == hi) & lo.isin(*self.args)
        if self.op == "neq":
            return full & ((lo > self.args[0]) | (hi < self.args[0]))
        if self.op == "like" or (bounds := self._bounds()) is None:
            return F.lit(False)
        if bounds[0] is not None:
            full = full & (lo >= bounds[0])
        return full & (hi <= bounds[1]) if bounds[1] is not None else full


@dataclass(frozen=True)
class PredicateSet:
    """All of its predicates hold; an empty set holds for every row."""

    predicates: tuple[Predicate, ...] = ()

    @staticmethod
    def of(*predicates: Predicate) -> PredicateSet:
        return PredicateSet(tuple(predicates))

    def column(self, schema: CubeSchema | None = None) -> Column:
        return reduce(lambda a, b: a & b, [p.column(schema) for p in self.predicates], F.lit(True))

    def may_hold(self) -> Column:
        return reduce(lambda a, b: a & b, [p.may_hold() for p in self.predicates], F.lit(True))

    def must_hold(self) -> Column:
        return reduce(lambda a, b: a & b, [p.must_hold() for p in self.predicates], F.lit(True))

    def key_range(self, schema: CubeSchema) -> tuple[int, int]:
        """The least and greatest key that can satisfy the set, both within the schema's bits; (1, 0), which is empty, if no code can."""
        low, high = {d.name: 0 for d in schema.dims}, {d.name: d.mask for d in schema.dims}
        for p in self.predicates:
            if (bounds := p._bounds()) is not None and p.dim in low:
                lo, hi = bounds
                low[p.dim] = max(low[p.dim], lo) if lo is not None else low[p.dim]
                high[p.dim] = min(high[p.dim], hi) if hi is not None else high[p.dim]
        if any(low[d] > high[d] for d in low):
            return 1, 0
        return schema.pack(low), schema.pack(high)


def any_of(sets: list[PredicateSet], schema: CubeSchema | None = None) -> Column:
    """Rows of which some set holds; overlapping sets count a row once."""
    return reduce(lambda a, b: a | b, [s.column(schema) for s in sets], F.lit(False))


def eq(dim, v):
    return Predicate(dim, "eq", (v,))


def between(dim, lo, hi):
    return Predicate(dim, "between", (lo, hi))


def isin(dim, *values):
    return Predicate(dim, "in", tuple(values))


@dataclass(frozen=True)
class KeyRange:
    """A closed interval of keys; ``low > high`` is empty."""

    low: int
    high: int

    def is_empty(self) -> bool:
        return self.low > self.high

    def contains(self, key: int) -> bool:
        return self.low <= key <= self.high

    def overlaps(self, other: KeyRange) -> bool:
        return not self.is_empty() and not other.is_empty() and self.low <= other.high and other.low <= self.high

    def fully_contains(self, other: KeyRange) -> bool:
        return self.low <= other.low and other.high <= self.high

    def column(self, key: str = "key") -> Column:
        return F.col(key).between(self.low, self.high)
