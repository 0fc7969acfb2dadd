"""Rounding and division with the results of the languages the formulas come from."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# From here on a double holds whole numbers only.
_WHOLE_FROM = float(2**52)


def half_up(x: Column) -> Column:
    """Nearest whole number, halves toward plus infinity, as a double. NaN and null pass through."""
    whole = F.ceil(F.floor(x * 2.0) / 2.0).cast("double")
    return F.when(F.abs(x) < _WHOLE_FROM, whole).otherwise(x)


def js_round(x: Column, digits: int = 2) -> Column:
    """``half_up(x * 10**digits) / 10**digits``: scaled, rounded and scaled back."""
    scale = F.lit(10.0**digits)
    return half_up(x * scale) / scale


def _scaled_exactly(x: Column, digits: int):
    """x * 10**digits as (whole part, fraction, what the product lost), exact for digits <= 6.

    A double times a power of ten is inexact; splitting x at single precision makes both
    partial products exact, so the lost part can be computed.
    """
    scale = F.lit(10.0**digits)
    product = x * scale
    head = x.cast("float").cast("double")
    lost = (head * scale - product) + (x - head) * scale
    whole = F.floor(product)
    return scale, whole, product - whole, lost


def exact_round(x: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even: what Python's ``round(x, digits)`` returns."""
    scale, whole, fraction, lost = _scaled_exactly(x, digits)
    tie = fraction == 0.5
    up = (fraction > 0.5) | (tie & ((lost > 0) | ((lost == 0) & (whole % 2 != 0))))
    rounded = (whole.cast("double") + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(F.abs(x * scale) < _WHOLE_FROM, rounded).otherwise(x)


def fixed_digits(x: Column, digits: int) -> Column:
    """Round the exact binary value of x >= 0, ties up: the number JavaScript's toFixed prints."""
    scale, whole, fraction, lost = _scaled_exactly(x, digits)
    up = (fraction > 0.5) | ((fraction == 0.5) & (lost >= 0))
    rounded = (whole.cast("double") + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(F.abs(x * scale) < _WHOLE_FROM, rounded).otherwise(x)


def floor_divide(a: Column, b: Column) -> Column:
    """``a // b`` of Python floats, as a double; null where b is 0.

    The remainder is exact, so 1.0 // 0.1 is 9 although 1.0 / 0.1 rounds to 10.
    """
    b = F.nullif(b, F.lit(0.0))
    rest = a % b
    opposite = (rest != 0) & ((rest < 0) != (b < 0))
    quotient = (a - rest) / b - F.when(opposite, 1.0).otherwise(0.0)
    return half_up(quotient)
