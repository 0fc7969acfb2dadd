"""Reproducible randomness: a function of the row key, whatever the partitioning."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits are 52 bits, which a double holds exactly.
_DIGITS = 13
_RANGE = float(2 ** (4 * _DIGITS))


def hash52(key: Column, salt: str) -> Column:
    """52 bits of md5 over "salt:key" as a whole-number double."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")


def uniform(key: Column, salt: str) -> Column:
    """Uniform on [0, 1)."""
    return hash52(key, salt) / _RANGE


def gaussian(key: Column, salt: str) -> Column:
    """Standard normal by the Box-Muller transform; the half step keeps the logarithm finite."""
    radius = F.sqrt(-2.0 * F.log((hash52(key, f"{salt}:r") + 0.5) / _RANGE))
    return radius * F.cos(2.0 * math.pi * uniform(key, f"{salt}:a"))
