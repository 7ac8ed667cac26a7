"""Sums, ratios, casts and flags with the null rules the panel operators rely on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(columns: Sequence[ColumnOrName]) -> Column:
    """Row-wise sum that is NULL as soon as one input is NULL."""
    return reduce(add, [_col(c) for c in columns])


def safe_ratio(numerator: ColumnOrName, denominator: ColumnOrName) -> Column:
    """``numerator / denominator``; NULL instead of an ANSI error when the denominator is 0."""
    return F.try_divide(_col(numerator), _col(denominator))


def relative_growth(later: ColumnOrName, base: ColumnOrName) -> Column:
    """``(later - base) / base``; NULL for a zero base."""
    return F.try_divide(_col(later) - _col(base), _col(base))


def weighted_mean(values: Sequence[ColumnOrName], weights: Sequence[ColumnOrName]) -> Column:
    """Weighted mean across columns of one row, NULL when any input is NULL or weights add to 0."""
    products = [_col(v) * _col(w) for v, w in zip(values, weights, strict=True)]
    return F.try_divide(strict_sum(products), strict_sum(weights))


def typed(column: ColumnOrName, data_type: str) -> Column:
    """Numeric cast that yields NULL for text that does not parse."""
    return _col(column).try_cast(data_type)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))
