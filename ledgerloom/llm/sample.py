"""Problem 2: a sample that stays the same across runs and as data grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that make the unit interval; 13 digits are 52 bits, exact in a double.
DIGITS = 13


def unit(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key and the salt only."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), key)), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**DIGITS))


def stable_sample(df: DataFrame, key: str, rate: float, salt: str) -> DataFrame:
    """The rows of ``df`` whose key falls below ``rate`` in the salted unit interval.

    The decision looks at the key alone: all rows of a key go the same way, no run or partitioning changes
    it, and rows added later leave it as it is.  A higher rate keeps all that a lower one keeps.  A null key
    is never selected; an empty string is a key like any other.
    """
    return df.filter(unit(F.col(key), salt) < rate)
