"""Group percentiles and the percentile cohorts built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import bits_value, ordered_bits
from cohortlens.operators.scale import join_group_stats, materialise

#: Accuracy of the sketch of ``method="approx"``; the rank error is at most n / ACCURACY.
ACCURACY = 10_000
#: Groups up to this size go to Spark's ``percentile``, whose state holds their distinct values.
WHOLE_GROUP_ROWS = 100_000
#: Bits of a value that one round of the rank search settles; a round counts at most 2^13 prefixes a rank.
ROUND_BITS = 13


def group_percentile(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    p: float | Mapping[str, float],
    name: str = "threshold",
    method: str = "exact",
    whole_group_rows: int | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles of ``value`` per group, one output row per group.

    ``p`` is one fraction (output column ``name``) or a mapping output column -> fraction. Rows
    with a NULL group key belong to no group.

    * ``exact``: keys and values are written once and group sizes counted. Up to
      ``whole_group_rows`` (default ``WHOLE_GROUP_ROWS``) rows per group, Spark's ``percentile``
      is used, whose state is then bounded. If a group is larger, ranks are searched for: rows
      are counted per leading bits of their value, the prefix that holds a rank is picked, and only
      rows with that prefix are counted by their next bits, until all bits are known. Five rounds
      at most, counts combine before the shuffle, and no task holds the values of a group. Right
      for groups of any size.
    * ``hash``: Spark's ``percentile``; holds the distinct values of a group in memory, for
      values with few distinct levels.
    * ``approx``: the sketch alone.
    """
    wanted = {name: p} if isinstance(p, (int, float)) else dict(p)
    by = list(by)
    v = F.col(value).cast("double")
    df = df.na.drop(subset=by) if by else df
    if method == "hash":
        return _whole_group_percentile(df, by, v, wanted)
    if method == "approx":
        return df.groupBy(*by).agg(
            *[F.percentile_approx(v, q, ACCURACY).alias(n) for n, q in wanted.items()]
        )
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")

    most = WHOLE_GROUP_ROWS if whole_group_rows is None else whole_group_rows
    narrow = materialise(df.select(*by, v.alias("_v")), "values")
    largest = narrow.groupBy(*by).agg(F.count("_v").alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= most:
        return _whole_group_percentile(narrow, by, F.col("_v"), wanted)
    return _searched_percentile(narrow, by, F.col("_v"), wanted)


def _whole_group_percentile(df: DataFrame, by: list[str], v: Column, wanted: Mapping[str, float]) -> DataFrame:
    together = F.percentile(v, F.array(*[F.lit(float(q)) for q in wanted.values()]))
    return df.groupBy(*by).agg(together.alias("_p")).select(
        *by, *[F.col("_p")[i].alias(n) for i, n in enumerate(wanted)]
    )


def _searched_percentile(df: DataFrame, by: list[str], v: Column, wanted: Mapping[str, float]) -> DataFrame:
    """Percentiles by a search for the wanted ranks over the ordered bits of the values."""
    groups = [f"g{i}" for i in range(len(by))] or ["g0"]
    named = [F.col(f"`{c}`").alias(g) for c, g in zip(by, groups)] or [F.lit(0).alias("g0")]
    rows = materialise(df.select(*named, ordered_bits(v).alias("bits")), "bits")
    groups_of = rows.groupBy(*groups).agg(F.count("bits").alias("n"), F.min("bits").alias("low"), F.max("bits").alias("high"))
    # Bits above the first one in which some group's values differ need no search.
    open_bits = F.when(F.col("low") < 0, F.lit(64)).otherwise(F.length(F.bin(F.col("low").bitwiseXOR(F.col("high")))))
    groups_of = materialise(groups_of.withColumn("open_bits", open_bits), "groups")
    shift = groups_of.agg(F.max("open_bits")).first()[0] or 0
    ranks = []
    for q in wanted.values():
        at = F.lit(float(q)) * (F.col("n") - 1)
        ranks += [F.floor(at).cast("long"), F.ceil(at).cast("long")]
    targets = groups_of.where("n > 0").select(
        *groups, F.explode(F.array_distinct(F.array(*ranks))).alias("rank"), _prefix(F.col("low"), shift).alias("prefix")
    )
    targets = materialise(targets.withColumn("left", F.col("rank")), "ranks")
    while shift:
        step = min(ROUND_BITS, shift)
        targets = materialise(_one_round(rows, targets, groups, shift, shift - step), "ranks")
        shift -= step
    valued = targets.select(*groups, "rank", bits_value(F.col("prefix")).alias("value"))
    found = valued.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("found"))
    outputs = []
    for (name, q), low, high in zip(wanted.items(), ranks[::2], ranks[1::2]):
        at = F.lit(float(q)) * (F.col("n") - 1)
        a, b = (F.element_at("found", r) for r in (low, high))
        between = (F.ceil(at) - at) * a + (at - F.floor(at)) * b
        outputs.append(F.when(low == high, a).when(a == b, a).otherwise(between).alias(name))
    keys = [F.col(g).alias(c) for c, g in zip(by, groups)]
    return groups_of.join(found, groups, "left").select(*keys, *outputs)


def _prefix(bits: Column, shift: int) -> Column:
    """What is left of the bits above the ``shift`` lowest; 64 leaves nothing."""
    return F.lit(0).cast("long") if shift >= 64 else F.shiftright(bits, shift)


def _one_round(rows: DataFrame, targets: DataFrame, groups: list[str], shift: int, next_shift: int) -> DataFrame:
    """Targets with the next bits of the value at their rank.

    ``targets`` has one row per group and rank: ``prefix`` of the value, and ``left``, the rank
    among the group's rows with that prefix.
    """
    open_prefixes = targets.groupBy(*groups).agg(F.collect_set("prefix").alias("prefixes"))
    inside = join_group_stats(rows, open_prefixes, groups).where(F.array_contains("prefixes", _prefix(F.col("bits"), shift)))
    counts = inside.groupBy(
        *groups, _prefix(F.col("bits"), shift).alias("prefix"), _prefix(F.col("bits"), next_shift).alias("next")
    ).agg(F.count(F.lit(1)).alias("n"))
    # At most 2^ROUND_BITS rows per group and prefix.
    upto = Window.partitionBy(*groups, "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("n").over(upto))
    hit = counts.join(targets, [*groups, "prefix"]).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
    return hit.select(*groups, "rank", F.col("next").alias("prefix"), (F.col("left") - F.col("upto") + F.col("n")).alias("left"))


def at_or_below(
    df: DataFrame, thresholds: DataFrame, by: Sequence[str], value: str, name: str, stored: bool = False
) -> DataFrame:
    """Rows whose value is at or below their group's threshold."""
    joined = join_group_stats(df, thresholds.select(*by, name), by, stored=stored)
    return joined.filter(F.col(value) <= F.col(name))


def eligible_cohort(
    panel: DataFrame,
    by: Sequence[str],
    value: str,
    p: float = 0.10,
    year: str = "year",
    max_year: int | None = None,
    thresholds: DataFrame | None = None,
    method: str = "exact",
    stored: bool = False,
) -> DataFrame:
    """Rows at or below the ``p`` percentile of their group, up to ``max_year``.

    ``thresholds`` (``*by``, ``threshold``) passes percentiles that are known already; ``stored``
    says that they are a written table.
    """
    base = panel if max_year is None else panel.filter(F.col(year) <= max_year)
    if thresholds is None:
        thresholds = group_percentile(base, by, value, p, "threshold", method)
    known = thresholds.select(*by, F.col("threshold").alias("_threshold"))
    return at_or_below(base, known, by, value, "_threshold", stored).select(*panel.columns)
