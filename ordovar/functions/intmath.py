"""Integer helpers of the round-based strategies, on the driver and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_log2(n: int) -> int:
    return max(0, (n - 1).bit_length())


def ceil_logk(n: int, k: int) -> int:
    """ceil(log2 n) div ceil(log2 k)."""
    return ceil_log2(n) // max(1, ceil_log2(k))


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def power_of_two_col(c: Column) -> Column:
    return (c > 0) & (c.bitwiseAND(c - 1) == 0)


def share(m: int, n: int, part: int) -> int:
    """Rows of a part when the first m % n parts get one more."""
    return m // n + (part < m % n)
