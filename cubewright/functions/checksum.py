"""Order-independent checksums of key sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the odd multiplier of 64-bit golden-ratio hashing.
GOLDEN = 0x9E3779B97F4A7C15


def key_xor(key: str = "key") -> Column:
    """XOR of all BIGINT keys (their upper 64 bits are 0)."""
    return F.bit_xor(key)


def fold_key(key: int) -> int:
    """A 128-bit key's 64-bit checksum: the low word XOR the high word times the multiplier."""
    return (key & (1 << 64) - 1) ^ ((key >> 64) * GOLDEN & (1 << 64) - 1)


def group_checksum(groups: dict[int, int]) -> int:
    """XOR over groups of (group * multiplier) XOR sum, in 64 bits."""
    out = 0
    for g, total in groups.items():
        out ^= (g * GOLDEN & (1 << 64) - 1) ^ (total & (1 << 64) - 1)
    return out


def group_term(group: str, total: str) -> Column:
    """(group * multiplier) XOR total in 64 bits, as a BIGINT; XOR it over groups, for what ``group_checksum`` says. Groups are below 2^31."""
    low = F.col(group).cast("long") * F.lit(GOLDEN & 0xFFFFFFFF)
    high = F.col(group).cast("long") * F.lit(GOLDEN >> 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseXOR(F.col(total))


def results_match(count_a: int, sum_a: float, xor_a: int, count_b: int, sum_b: float, xor_b: int) -> bool:
    """Counts and checksums are equal and sums are within 1 or a millionth."""
    return count_a == count_b and xor_a == xor_b and abs(sum_a - sum_b) <= max(1.0, 1e-6 * abs(sum_a))
