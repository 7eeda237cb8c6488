"""Dimension schemas: how values become codes and codes become one order-preserving key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIMS = 8


@dataclass(frozen=True)
class Dimension:
    """A dimension of ``bits`` bits: linear (value * scale - base) or, with ``labels``, a dictionary in their order.

    The highest code of a nullable dimension stands for NULL inside a packed key; columns hold real NULLs.
    """

    name: str
    bits: int
    base: int = 0
    scale: int = 1
    labels: tuple[str, ...] | None = None
    nullable: bool = True

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1

    @property
    def null_code(self) -> int:
        return self.mask

    @property
    def max_code(self) -> int:
        return self.mask - (1 if self.nullable else 0)

    def encode(self, value: Column) -> Column:
        """Integers: shift by the base and clamp to the code range; NULL stays NULL."""
        code = F.greatest(F.lit(0), F.least(value.cast("long") - self.base, F.lit(self.max_code))).cast("long")
        return F.when(value.isNotNull(), code)  # greatest and least alone would skip a NULL

    def encode_float(self, value: Column) -> Column:
        """Fixed point: scale, cut the fraction off towards zero, then as an integer."""
        scaled = value * self.scale
        return self.encode(F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)))

    def encode_string(self, value: Column, unknown_as_zero: bool = False) -> Column:
        """The label's place; an unknown label is NULL, or 0 for parity with stores that have no other answer."""
        table = F.create_map(*[x for i, s in enumerate(self.labels or ()) for x in (F.lit(s), F.lit(i).cast("long"))])
        code = F.try_element_at(table, value)
        return F.coalesce(code, F.when(value.isNotNull(), F.lit(0).cast("long"))) if unknown_as_zero else code

    def decode_int(self, code: Column) -> Column:
        return code + self.base

    def decode_float(self, code: Column) -> Column:
        return code / self.scale

    def decode_string(self, code: Column) -> Column:
        return F.get(F.array(*[F.lit(s) for s in self.labels or ()]), code.cast("int"))

    def is_null_code(self, code: Column) -> Column:
        return code == self.null_code if self.nullable else F.lit(False)


@dataclass(frozen=True)
class CubeSchema:
    """Dimensions in order of significance; the key of up to 63 bits is a BIGINT, a wider one BINARY(16), big-endian."""

    dims: tuple[Dimension, ...]
    offsets: dict[str, int] = field(init=False)

    def __post_init__(self):
        if not 0 < len(self.dims) <= MAX_DIMS:
            raise ValueError(f"1 to {MAX_DIMS} dimensions, not {len(self.dims)}")
        if any(d.bits < 1 or d.bits > 63 for d in self.dims) or self.total_bits > 128:
            raise ValueError("a dimension has 1 to 63 bits, a key at most 128")
        at, offsets = self.total_bits, {}
        for d in self.dims:
            at -= d.bits
            offsets[d.name] = at
        object.__setattr__(self, "offsets", offsets)

    @property
    def total_bits(self) -> int:
        return sum(d.bits for d in self.dims)

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dims]

    def dim(self, name: str) -> Dimension:
        return next(d for d in self.dims if d.name == name)

    def key(self, columns: dict[str, Column] | None = None) -> Column:
        """Pack code columns into the key; NULL takes the dimension's highest code."""
        cols = columns or {d.name: F.col(d.name) for d in self.dims}
        codes = {d.name: F.coalesce(cols[d.name].cast("long"), F.lit(d.null_code).cast("long")) for d in self.dims}
        if self.total_bits <= 63:
            total = F.lit(0).cast("long")
            for d in self.dims:
                total = total.bitwiseOR(F.shiftleft(codes[d.name], self.offsets[d.name]))
            return total
        digits = F.concat(*[F.lpad(F.bin(codes[d.name]), d.bits, "0") for d in self.dims])
        digits = F.lpad(digits, 128, "0")
        return F.unhex(F.concat(*[F.lpad(F.conv(F.substring(digits, 16 * i + 1, 16), 2, 16), 4, "0") for i in range(8)]))

    def extract(self, name: str, key: Column | None = None) -> Column:
        """A dimension's code out of a BIGINT key."""
        if self.total_bits > 63:
            raise ValueError("codes of a wide key are read from their own columns")
        key = F.col("key") if key is None else key
        return F.shiftrightunsigned(key, self.offsets[name]).bitwiseAND(F.lit(self.dim(name).mask).cast("long"))

    def pack(self, codes: dict[str, int]) -> int:
        """A key from plain integers (missing dimension: 0)."""
        return sum((codes.get(d.name, 0) & d.mask) << self.offsets[d.name] for d in self.dims)

    def unpack(self, key: int) -> dict[str, int]:
        return {d.name: (key >> self.offsets[d.name]) & d.mask for d in self.dims}


#: The dictionaries of the default sales schema.
STATES = ("AZ", "CA", "FL", "GA", "IL", "MA", "MI", "NC", "NJ", "NY", "OH", "PA", "TX", "VA", "WA")
PRODUCTS = ("Chair", "Desk", "Default", "Headset", "Keyboard", "Laptop", "Monitor", "Mouse", "Webcam")


def sales_schema() -> CubeSchema:
    """The default 56-bit schema: date parts, two dictionaries, price in cents and version in hundredths."""
    return CubeSchema((
        Dimension("year", 8, base=2000), Dimension("month", 4, base=1), Dimension("day", 5, base=1),
        Dimension("state", 5, labels=STATES), Dimension("product", 5, labels=PRODUCTS),
        Dimension("price", 19, scale=100), Dimension("version", 10, scale=100)))


def orders_schema() -> CubeSchema:
    """The 61-bit schema of the cube over lineitem: state is the nation's key, product the brand's number."""
    return CubeSchema((
        Dimension("year", 8, base=1990), Dimension("month", 4, base=1), Dimension("day", 5, base=1),
        Dimension("state", 5), Dimension("product", 5), Dimension("price", 24, scale=100), Dimension("version", 10, scale=100)))
