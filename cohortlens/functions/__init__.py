"""Column expressions shared by the operators; every one stays inside whole-stage codegen."""

from cohortlens.functions.arithmetic import (
    flag,
    relative_growth,
    safe_ratio,
    strict_sum,
    typed,
    weighted_mean,
)
from cohortlens.functions.geometry import planar_distance
from cohortlens.functions.ordering import bits_value, ordered_bits
from cohortlens.functions.text import join_key, leading, text_after, without_first, without_last

__all__ = [
    "bits_value",
    "flag",
    "join_key",
    "leading",
    "ordered_bits",
    "planar_distance",
    "relative_growth",
    "safe_ratio",
    "strict_sum",
    "text_after",
    "typed",
    "weighted_mean",
    "without_first",
    "without_last",
]
