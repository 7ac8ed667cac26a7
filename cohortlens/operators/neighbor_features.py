"""Features of neighbouring entities: attach them, and summarise them by weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_neighbors(
    nearest_rows: DataFrame, panel: DataFrame, id: str, year: str, columns: Sequence[str]
) -> DataFrame:
    """One join of the long neighbour table with the panel; keeps neighbours without a panel row."""
    side = panel.select(F.col(id).alias("nid"), year, *columns)
    return nearest_rows.select(id, year, "rank", "nid").join(side, ["nid", year], "left")


def _weighted(value: str, weight: str, strict: bool) -> Column:
    v, w = F.col(value), F.col(weight)
    product = v * w
    mean = F.try_divide(F.sum(product), F.sum(F.when(v.isNotNull(), w)))
    return F.when(F.count(product) == F.count("*"), mean) if strict else mean


def _total(value: str, strict: bool) -> Column:
    total = F.sum(value)
    return F.when(F.count(value) == F.count("*"), total) if strict else total


def neighbor_features(
    nearest_rows: DataFrame,
    panel: DataFrame,
    *,
    id: str,
    year: str = "year",
    weight: str,
    mean_cols: Sequence[str],
    sum_cols: Sequence[str] = (),
    strict: bool = True,
    min_neighbors: int = 0,
    prefix: str = "n_",
) -> DataFrame:
    """Weighted means and totals over each entity's neighbours, one row per (``id``, ``year``).

    ``strict`` makes an output NULL when one neighbour lacks the value; otherwise the mean runs
    over the neighbours that have it. Rows with fewer than ``min_neighbors`` are left out.
    """
    columns = list(dict.fromkeys([*mean_cols, *sum_cols, weight]))
    attached = attach_neighbors(nearest_rows, panel, id, year, columns)
    aggs = [_weighted(c, weight, strict).alias(prefix + c) for c in mean_cols]
    aggs += [_total(c, strict).alias(prefix + c) for c in sum_cols]
    summary = attached.groupBy(id, year).agg(*aggs, F.count("*").alias("_neighbors"))
    return summary.filter(F.col("_neighbors") >= min_neighbors).drop("_neighbors")


def neighbor_features_upto(
    nearest_rows: DataFrame,
    panel: DataFrame,
    *,
    id: str,
    year: str = "year",
    weight: str,
    mean_cols: Sequence[str],
    sum_cols: Sequence[str] = (),
    prefix: str = "n_",
) -> DataFrame:
    """Strict neighbour summaries for every neighbour count at once.

    Row ``(id, year, k)`` summarises the neighbours of rank 1..k, by running sums over the few
    ranked neighbours of one entity: a sweep over k needs a single pass.
    """
    columns = list(dict.fromkeys([*mean_cols, *sum_cols, weight]))
    attached = attach_neighbors(nearest_rows, panel, id, year, columns)
    upto = (
        Window.partitionBy(id, year)
        .orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def complete(c: Column, result: Column) -> Column:
        return F.when(F.count(c).over(upto) == F.col("rank"), result)

    w = F.col(weight)
    outputs = {}
    for c in mean_cols:
        product = F.col(c) * w
        mean = F.try_divide(F.sum(product).over(upto), F.sum(w).over(upto))
        outputs[prefix + c] = complete(product, mean)
    for c in sum_cols:
        outputs[prefix + c] = complete(F.col(c), F.sum(c).over(upto))
    return attached.select(
        id, year, F.col("rank").alias("k"), *[expr.alias(name) for name, expr in outputs.items()]
    )


def neighbor_columns_wide(
    nearest_rows: DataFrame, panel: DataFrame, *, id: str, year: str, columns: Sequence[str], k: int
) -> DataFrame:
    """One row per (``id``, ``year``) with ``0_<column>`` .. ``{k-1}_<column>`` of its neighbours."""
    attached = attach_neighbors(nearest_rows, panel, id, year, columns)
    at_rank = [
        F.max(F.when(F.col("rank") == r + 1, F.col(c))).alias(f"{r}_{c}")
        for r in range(k)
        for c in columns
    ]
    return attached.groupBy(id, year).agg(*at_rank)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """All columns renamed to ``<prefix>_<name>``."""
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns})
