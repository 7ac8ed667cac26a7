"""Doubles as whole numbers in the same order, and back, by exact arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 64-bit floating-point format.
_FRACTION = 1 << 52
_BIAS = 1023
_SPECIAL = 2047 * _FRACTION
_LEAST_NORMAL = 2.0**-1022
_HALF_SCALE = 2.0**537


def ordered_bits(value: Column) -> Column:
    """Whole number that orders as the double does; equal values give equal numbers.

    Both zeros give 0, NaN is the largest value, NULL stays NULL. Exponent and fraction are found
    by dividing by powers of two, which is exact.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("int")
    two = F.lit(2.0)
    exponent = guess + F.when(size < F.pow(two, guess), -1).when(size >= F.pow(two, guess + 1), 1).otherwise(0)
    fraction = ((size / F.pow(two, exponent) - 1) * float(_FRACTION)).cast("long")
    normal = (exponent + _BIAS).cast("long") * _FRACTION + fraction
    small = (size * _HALF_SCALE * _HALF_SCALE).cast("long")
    bits = (
        F.when(F.isnan(value), F.lit(_SPECIAL + 1))
        .when(size == float("inf"), F.lit(_SPECIAL))
        .when(size < _LEAST_NORMAL, small)
        .otherwise(normal)
    )
    return F.when(value.isNotNull(), F.when(value < 0, -bits).otherwise(bits))


def bits_value(bits: Column) -> Column:
    """The double that :func:`ordered_bits` gave ``bits`` for."""
    size = F.abs(bits)
    exponent = F.shiftright(size, 52).cast("int")
    fraction = size.bitwiseAND(F.lit(_FRACTION - 1)).cast("double")
    normal = (1 + fraction / float(_FRACTION)) * F.pow(F.lit(2.0), exponent - _BIAS)
    value = (
        F.when(size > _SPECIAL, F.lit(float("nan")))
        .when(size == _SPECIAL, F.lit(float("inf")))
        .when(exponent == 0, fraction / _HALF_SCALE / _HALF_SCALE)
        .otherwise(normal)
    )
    return F.when(bits < 0, -value).otherwise(value)
