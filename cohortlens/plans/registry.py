"""Named queries with their independent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``covers`` lists inventory ids."""

    def register(fn: Query) -> Query:
        if fn.__name__ in ENTRIES:
            raise ValueError(f"query {fn.__name__} registered twice")
        ENTRIES[fn.__name__] = Entry(fn.__name__, fn, sql, tuple(covers.split()))
        return fn

    return register
