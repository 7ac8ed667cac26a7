"""Labels that look ahead in time: what happens to an entity in the years after its base row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import flag, relative_growth
from cohortlens.operators.cohort import group_percentile
from cohortlens.operators.scale import broadcast_if_small, join_group_stats, materialise


def lookahead_label(
    cohort: DataFrame,
    panel: DataFrame,
    *,
    id: str,
    year: str = "year",
    group: Sequence[str],
    growth_col: str,
    level_col: str,
    horizon: int = 3,
    growth: float = 0.20,
    p: float = 0.20,
    benchmark: str = "future",
    match: str = "any",
    benchmarks: DataFrame | None = None,
    stored: bool = False,
    label: str = "label",
    keep_evidence: bool = False,
) -> DataFrame:
    """Add a 0/1 label to each cohort row.

    1 when, within ``horizon`` years after the base year, the best ``growth_col`` grew by at
    least ``growth`` over the base, or ``level_col`` reached the group's ``p`` percentile.

    * ``benchmark='future'`` compares with the benchmark of the looked-at year, ``'base'``
      with the one of the base year.
    * ``match='any'`` accepts any of the years, ``'first'`` looks at the first year present.
    * ``benchmarks`` may pass the percentile table (``*group``, ``year``, ``benchmark``);
      ``stored`` says that it is a written table already.

    Only rows of the cohort's entities are shuffled; they are reduced to one row per (entity,
    year) before the join, and the join is a plain equi join on (entity, looked-at year), so a
    much repeated entity cannot pile up. Benchmarks are written and counted while the result is
    being built, unless they are stored.
    """
    if benchmark not in ("future", "base") or match not in ("any", "first"):
        raise ValueError("benchmark is 'future' or 'base', match is 'any' or 'first'")
    keys = [*group, year]
    if benchmarks is None:
        benchmarks = group_percentile(panel, keys, level_col, p, "benchmark")

    later = panel.select(id, *keys, growth_col, level_col)
    base = cohort.select(id, *keys).distinct()
    entities = materialise(cohort.select(id).distinct(), "entities")
    later = later.join(broadcast_if_small(entities), id, "left_semi")
    if benchmark == "future":
        later = join_group_stats(later, benchmarks, keys, "left", stored=stored)
        reached = F.col(level_col) >= F.col("benchmark")
    else:
        base = join_group_stats(base, benchmarks, keys, "left", stored=stored)
        reached = F.lit(None).cast("boolean")
    later = (
        later.groupBy(F.col(id), F.col(year).alias("_later_year"))
        .agg(
            F.max(growth_col).alias("_best"),
            F.max(level_col).alias("_level"),
            F.bool_or(reached).alias("_reached"),
        )
    )
    ahead = base.withColumn(
        "_later_year", F.explode(F.sequence(F.col(year) + 1, F.col(year) + horizon))
    ).join(later, [id, "_later_year"])
    hit = F.col("_reached") if benchmark == "future" else F.col("_level") >= F.col("benchmark")
    chosen = F.bool_or(hit) if match == "any" else F.min_by(hit, "_later_year")
    evidence = ahead.groupBy(id, year).agg(
        F.max("_best").alias("max_growth_col"),
        chosen.alias("level_reached"),
        F.count("*").alias("years_seen"),
    )
    met = (relative_growth(F.col("max_growth_col"), F.col(growth_col)) >= growth) | F.col("level_reached")
    labelled = cohort.join(evidence, [id, year], "left").withColumn(label, flag(met))
    keep = [*cohort.columns, label]
    if keep_evidence:
        keep += ["max_growth_col", "level_reached", "years_seen"]
    return labelled.select(*keep)


def forward_max(
    panel: DataFrame, id: str, year: str, value: str, horizon: int = 3, name: str = "forward_max"
) -> DataFrame:
    """Largest ``value`` over the next ``horizon`` calendar years, by a RANGE frame (gap safe).

    Rows are reduced to one per (entity, year) first, so a frame never holds more rows than the
    panel has years.
    """
    yearly = panel.groupBy(id, year).agg(F.max(value).alias(value))
    ahead = Window.partitionBy(id).orderBy(year).rangeBetween(1, horizon)
    return yearly.withColumn(name, F.max(value).over(ahead))
