"""String helpers for identifiers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_after(column: Column | str, marker: str) -> Column:
    """Second piece of the text cut at ``marker``; NULL when the marker is absent."""
    return F.get(F.split(column, rf"\Q{marker}\E"), F.lit(1))


def leading(column: Column | str, length: int) -> Column:
    """First ``length`` characters."""
    return F.substring(column, 1, length)


def without_last(column: Column | str, length: int = 1) -> Column:
    """Text without its last ``length`` characters."""
    c = F.col(column) if isinstance(column, str) else column
    return c.substr(F.lit(1), F.greatest(F.length(c) - F.lit(length), F.lit(0)))


def without_first(column: Column | str, length: int) -> Column:
    """Text without its first ``length`` characters."""
    c = F.col(column) if isinstance(column, str) else column
    return c.substr(F.lit(length + 1), F.length(c))


def join_key(*parts: Column | str, sep: str = "_") -> Column:
    """Parts joined to one key or file name."""
    return F.concat_ws(sep, *[F.col(p) if isinstance(p, str) else p for p in parts])
