"""Exact k-nearest-neighbour join over points, without pairing up whole groups.

How it works, all with DataFrame operations:

1. Points at the same place are interchangeable apart from their id, and ties are broken by id,
   so per place only the k + 1 smallest ids can ever be neighbours.
2. Candidates are put on a Z-order curve and cut into even range blocks. Points next to each
   other on the curve share a quadtree cell, so comparing a row with rows k steps away gives
   the deepest cell around it that holds at least k + 1 candidates. Dense areas get small cells
   and sparse areas large ones.
3. A cell of side s with k + 1 candidates bounds the k-th distance by s * sqrt(2), and so does the
   box around k + 1 rows in a row. Each place is therefore joined, by cell, only with cells of
   that size within that distance (at most 25), and the result is exact: no ring has to be
   widened afterwards.
4. A cell one level deeper holds at most k of the places that stop at a level, so every cell
   meets a bounded number of searchers: the pairs grow with n * k, not with n * n.
5. The grid spans the extent of each ``within`` group. If one finest cell holds very many places
   (a far outlier stretches the extent, or points crowd together), that cell and its surroundings
   become a group of their own with a grid over their own extent. Each such round adds 42 bits of
   resolution, so it ends for any coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import planar_distance
from cohortlens.operators.scale import broadcast_if_small, join_group_stats, materialise, range_blocks

#: Depth of the finest cells, 2**44 per axis, so that one stray point far away does not push all
#: others into a single cell. The Z-order code is kept in two halves of 2 * 22 bits.
HALF_DEPTH = 22
DEPTH = 2 * HALF_DEPTH
#: Rows per range block and per slice of a crowded cell.
BLOCK_ROWS = 1_000_000
#: A finest cell with more places than this gets a grid of its own.
CROWDED_PLACES = 2_048
#: Columns that carry the grid of a group: its corner and side, in scaled coordinates.
GRID = ("_x0", "_y0", "_side", "_scale")

#: Fixed bit masks of the usual bit-interleaving steps (shift, mask).
SPREAD_STEPS = (
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
)


def _spread_bits(c: Column) -> Column:
    for step, mask in SPREAD_STEPS:
        c = c.bitwiseOR(F.shiftleft(c, step)).bitwiseAND(F.lit(mask))
    return c


def _shift_right(c: Column | str, bits: Column) -> Column:
    return F.call_function("shiftright", F.col(c) if isinstance(c, str) else c, bits)


def _z_half(ix: Column, iy: Column) -> Column:
    return F.shiftleft(_spread_bits(ix), 1).bitwiseOR(_spread_bits(iy))


def _z_order(ix: str, iy: str) -> dict[str, Column]:
    """Z-order code of a fine cell in two columns: leading and trailing bits."""
    high = [F.shiftright(c, HALF_DEPTH) for c in (ix, iy)]
    low = [F.col(c).bitwiseAND(F.lit(2**HALF_DEPTH - 1)) for c in (ix, iy)]
    return {"_zhigh": _z_half(*high), "_zlow": _z_half(*low)}


def _shared_level(high: Column, low: Column) -> Column:
    """Deepest quadtree level two Z-order codes share, from the XOR of their halves."""

    def shared(differing: Column) -> Column:
        return (F.lit(HALF_DEPTH) - F.floor(F.log2(differing) / 2) - 1).cast("int")

    return (
        F.when(high > 0, shared(high))
        .when(low > 0, F.lit(HALF_DEPTH) + shared(low))
        .when((high == 0) & (low == 0), F.lit(DEPTH))
    )


def _cell_levels(candidates: DataFrame, key: Sequence[str], k: int, blocks: int) -> DataFrame:
    """Deepest full cell around each candidate row, as ``_level``, and a distance ``_bound``.

    Along the curve, k + 1 consecutive rows lie in one cell exactly down to the smallest level
    shared by two neighbours among them. A row's level is the best of the k + 1 such runs around
    it: a sliding minimum followed by a sliding maximum. The far corner of the box around the
    run centred on the row bounds its k-th distance as well.
    """
    order = ["_zhigh", "_zlow", "_id"]

    def deepest(df: DataFrame, *block: str) -> DataFrame:
        along = Window.partitionBy(*block, *key).orderBy(*order)
        run = along.rowsBetween(Window.currentRow, k - 1)
        runs_around = along.rowsBetween(-k, Window.currentRow)
        step = _shared_level(*[F.col(c).bitwiseXOR(F.lead(c).over(along)) for c in ("_zhigh", "_zlow")])
        box = along.rowsBetween(-(k // 2), k - k // 2)
        far = [
            F.greatest(
                F.max(c).over(box) * F.col("_scale") - F.col(c) * F.col("_scale"),
                F.col(c) * F.col("_scale") - F.min(c).over(box) * F.col("_scale"),
            )
            for c in ("_x", "_y")
        ]
        bound = F.when(F.count("_id").over(box) == k + 1, F.hypot(*far))
        full_run = F.when(F.count("_step").over(run) == k, F.min("_step").over(run))
        return (
            df.withColumns({"_step": step, "_bound": bound})
            .withColumn("_run", full_run)
            .withColumn("_level", F.coalesce(F.max("_run").over(runs_around), F.lit(0)))
            .select(*candidates.columns, "_level", "_bound")
        )

    if blocks == 1:  # counted: every group fits one block
        return deepest(candidates)
    ordered = range_blocks(candidates, [*key, *order], blocks)
    # Rows near a block edge are looked at once more together with the rows across the edge.
    up = Window.partitionBy("_block").orderBy(*key, *order)
    down = Window.partitionBy("_block").orderBy(*[F.desc(c) for c in (*key, *order)])
    head = ordered.withColumn("_r", F.row_number().over(up)).filter(F.col("_r") <= 2 * k)
    tail = ordered.withColumn("_r", F.row_number().over(down)).filter(F.col("_r") <= 2 * k)
    edges = head.withColumn("_edge", F.col("_block")).unionByName(
        tail.withColumn("_edge", F.col("_block") + 1)
    )
    both = deepest(ordered, "_block").unionByName(deepest(edges, "_edge"))
    return both.groupBy(*candidates.columns).agg(
        F.max("_level").alias("_level"), F.min("_bound").alias("_bound")
    )


def _slice_crowded(asked: DataFrame, offered: DataFrame, cell: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cells with more candidates than one block are cut into slices, each searcher asks all of them.

    Only few searchers meet such a cell: those in a sparse place next to a dense one.
    """
    crowded = (
        offered.groupBy(*cell)
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > BLOCK_ROWS)
        .select(*cell, F.ceil(F.col("_rows") / BLOCK_ROWS).cast("int").alias("_slices"))
    )
    crowded = materialise(crowded, "crowded")
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    cut = join_group_stats(offered, crowded, cell, "left", stored=True)
    cut = cut.withColumn("_slice", F.pmod(F.xxhash64("_nid"), slices).cast("int")).drop("_slices")
    every = F.explode(F.sequence(F.lit(0), slices - 1))
    spread = join_group_stats(asked, crowded, cell, "left", stored=True)
    return spread.withColumn("_slice", every).drop("_slices"), cut


def _distance() -> Column:
    """Planar distance; outside the range where squares are safe, without squaring."""
    near = planar_distance(F.col("_x"), F.col("_y"), F.col("_nx"), F.col("_ny"))
    apart = F.hypot(F.col("_x") * 0.5 - F.col("_nx") * 0.5, F.col("_y") * 0.5 - F.col("_ny") * 0.5) * 2.0
    return F.when((near > 1e-150) & (near < 1e150), near).otherwise(apart)


def _with_grid(pts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds the grid of each group and the finest cell of each row.

    Coordinates beyond 1e300 are scaled down by a power of two first, so no difference overflows.
    """
    largest = F.greatest(F.max(F.abs("_x")), F.max(F.abs("_y")))
    scale = F.when(largest > 1e300, F.lit(0.25)).otherwise(F.lit(1.0))
    width = F.greatest(F.max("_x") * scale - F.min("_x") * scale, F.max("_y") * scale - F.min("_y") * scale)
    grids = pts.groupBy(*key).agg(
        (F.min("_x") * scale).alias("_x0"),
        (F.min("_y") * scale).alias("_y0"),
        F.when(width > 0, width).otherwise(F.lit(1.0)).alias("_side"),
        scale.alias("_scale"),
    )

    def fine(c: str, start: str) -> Column:
        steps = F.floor((F.col(c) * F.col("_scale") - F.col(start)) / F.col("_side") * F.lit(2.0**DEPTH))
        return F.least(F.greatest(steps, F.lit(0)), F.lit(2**DEPTH - 1)).cast("bigint")

    return join_group_stats(pts, grids, key).withColumns({"_ix": fine("_x", "_x0"), "_iy": fine("_y", "_y0")})


def _closest_lists(pts: DataFrame, searched: DataFrame | None, key: Sequence[str], k: int) -> DataFrame:
    """The ``k + 1`` closest candidates of each place as ``_near``, per ``key``, ``_x``, ``_y``.

    ``pts`` has ``key``, ``_id``, ``_x``, ``_y``; ``searched`` limits the places asked for.
    """
    place = [*key, "_x", "_y"]
    n = pts.count()
    at_place = Window.partitionBy(*place).orderBy("_id")
    few = pts.withColumn("_at", F.row_number().over(at_place)).filter(F.col("_at") <= k + 1).drop("_at")
    candidates = _with_grid(few, key).withColumns(_z_order("_ix", "_iy"))
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    leveled = materialise(_cell_levels(candidates, key, k, blocks), "cells")

    places = leveled.groupBy(*place, "_ix", "_iy", *GRID).agg(
        F.max("_level").alias("_level"), F.min("_bound").alias("_bound")
    )
    fine_cell = [*key, "_ix", "_iy"]
    crowded = places.filter(F.col("_level") == DEPTH).groupBy(*fine_cell).count()
    crowded = materialise(crowded.filter(F.col("count") > CROWDED_PLACES).select(*fine_cell), "crowded")
    if searched is not None:
        places = places.join(searched.select(*place).distinct(), place, "left_semi")
    closer = None
    if not crowded.isEmpty():
        inner = materialise(places.join(broadcast_if_small(crowded), fine_cell, "left_semi").select(*place, "_ix", "_iy"), "inner")
        places = places.join(broadcast_if_small(crowded), fine_cell, "left_anti")
        closer = _inside_crowded(leveled, inner, crowded, key, k)

    # Cells of the searcher's own size that reach into its search radius.
    level = F.col("_level")
    size = F.col("_side") / F.pow(F.lit(2.0), level)
    ring = F.sequence(F.lit(-2), F.lit(2))
    depth = F.lit(DEPTH) - level

    def gap(c: str, start: str, cell: str) -> Column:
        low = F.col(start) + F.col(cell) * F.col("_size")
        at = F.col(c) * F.col("_scale")
        return F.greatest(low - at, at - low - F.col("_size"), F.lit(0.0))

    # A fine cell's share covers rounding when points are put into cells.
    reach = F.least(
        (F.col("_size") + F.lit(0.1 / 2.0**DEPTH) * F.col("_side")) * math.sqrt(2.0),
        F.col("_bound") * (1 + 1e-12),
    )
    cells_per_axis = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
    asked = (
        places.withColumn("_size", size)
        .withColumn("_dx", F.explode(ring))
        .withColumn("_dy", F.explode(ring))
        .withColumns({
            "_cx": _shift_right(F.col("_ix"), depth) + F.col("_dx"),
            "_cy": _shift_right(F.col("_iy"), depth) + F.col("_dy"),
        })
        .filter((F.col("_cx") >= 0) & (F.col("_cx") < cells_per_axis))
        .filter((F.col("_cy") >= 0) & (F.col("_cy") < cells_per_axis))
        .filter(F.hypot(gap("_x", "_x0", "_cx"), gap("_y", "_y0", "_cy")) <= reach)
        .select(*place, "_level", "_cx", "_cy", "_scale", reach.alias("_reach"))
    )
    levels = places.groupBy(*key).agg(F.collect_set("_level").alias("_levels"))
    offered = (
        join_group_stats(leveled.select(*key, F.col("_id").alias("_nid"), F.col("_x").alias("_nx"),
                                        F.col("_y").alias("_ny"), "_ix", "_iy"), levels, key)
        .withColumn("_level", F.explode("_levels"))
        .withColumns({
            "_cx": _shift_right(F.col("_ix"), depth),
            "_cy": _shift_right(F.col("_iy"), depth),
        })
        .drop("_ix", "_iy", "_levels")
    )
    cell = [*key, "_level", "_cx", "_cy"]
    if n > BLOCK_ROWS:  # otherwise no cell can hold more than one block
        asked, offered = _slice_crowded(asked, offered, cell)
        cell.append("_slice")
    scaled = F.hypot(*[F.col(a) * F.col("_scale") - F.col(b) * F.col("_scale") for a, b in (("_x", "_nx"), ("_y", "_ny"))])
    pairs = (
        asked.join(offered, cell)
        .filter(scaled <= F.col("_reach") * (1 + 1e-9))
        .select(*place, "_nid", _distance().alias("_dist"))
    )
    closest = Window.partitionBy(*place).orderBy("_dist", "_nid")
    lists = (
        pairs.withColumn("_rank", F.row_number().over(closest))
        .filter(F.col("_rank") <= k + 1)
        .groupBy(*place)
        .agg(F.sort_array(F.collect_list(F.struct("_dist", "_nid"))).alias("_near"))
    )
    return lists if closer is None else lists.unionByName(closer)


def _inside_crowded(leveled: DataFrame, inner: DataFrame, crowded: DataFrame, key: Sequence[str], k: int) -> DataFrame:
    """Closest candidates of the places in crowded finest cells, by a grid over each such cell.

    A finest cell with more than k candidates bounds the k-th distance by its diagonal, so nothing
    beyond two cells around it can be among the closest.
    """
    around = F.sequence(F.lit(-2), F.lit(2))
    gx, gy = (f"_g{axis}{len(key)}" for axis in "xy")  # cells inside cells need names of their own
    ring = (
        crowded.select(*key, F.col("_ix").alias(gx), F.col("_iy").alias(gy))
        .withColumn("_dx", F.explode(around))
        .withColumn("_dy", F.explode(around))
        .select(*key, gx, gy, (F.col(gx) + F.col("_dx")).alias("_ix"), (F.col(gy) + F.col("_dy")).alias("_iy"))
    )
    members = leveled.join(broadcast_if_small(materialise(ring, "ring")), [*key, "_ix", "_iy"])
    group = [*key, gx, gy]
    members = materialise(members.select(*group, "_id", "_x", "_y"), "points")
    asked = inner.select(*key, F.col("_ix").alias(gx), F.col("_iy").alias(gy), "_x", "_y")
    return _closest_lists(members, asked, group, k).drop(gx, gy)


def nearest(
    points: DataFrame,
    id: str,
    x: str,
    y: str,
    within: Sequence[str],
    k: int,
    queries: DataFrame | None = None,
    stored: bool = False,
) -> DataFrame:
    """The ``k`` nearest other points of each point, inside its ``within`` group.

    ``points`` has one row per (``within``, ``id``). Distance is planar; equal distances are
    ordered by id; a point is never its own neighbour; a group with fewer than k + 1 points
    yields the neighbours it has. Points without a group or a finite place are left out; any
    finite coordinates give full results. ``queries`` (columns ``within`` + ``id``) limits the
    search to some of the points while all of them remain candidates. ``stored`` says that
    ``points`` is a plain table scan already, so it need not be written before its passes. Cell
    levels and counts are worked out, and small tables written, while the result is being built.

    Returns ``within``, ``id``, ``rank`` (1..k), ``nid``, ``dist``.
    """
    # Without a group column, one constant group keeps the joins equal.
    names = list(within)
    key = [f"_w{i}" for i in range(len(names))] or ["_w"]
    groups = [F.col(w).alias(a) for w, a in zip(names, key)] or [F.lit(0).alias("_w")]
    pts = points.select(
        *groups,
        F.col(id).alias("_id"),
        F.col(x).cast("double").alias("_x"),
        F.col(y).cast("double").alias("_y"),
    ).na.drop(subset=[*key, "_x", "_y"])
    finite = [F.abs(c) < F.lit(float("inf")) for c in ("_x", "_y")]
    pts = pts.filter(finite[0] & finite[1])
    if not stored:
        pts = materialise(pts, "points")
    place = [*key, "_x", "_y"]
    searchers, searched = pts, None
    if queries is not None:
        wanted = queries.select(*groups, F.col(id).alias("_id"))
        searchers = searched = materialise(pts.join(wanted.distinct(), [*key, "_id"], "left_semi"), "asked")
    lists = _closest_lists(pts, searched, key, k)
    others = F.slice(F.filter("_near", lambda c: c["_nid"] != F.col("_id")), 1, k)
    return (
        searchers.join(lists, place)
        .select(*key, "_id", F.posexplode(others).alias("_pos", "_near"))
        .select(
            *[F.col(a).alias(w) for w, a in zip(names, key)],
            F.col("_id").alias(id),
            (F.col("_pos") + 1).alias("rank"),
            F.col("_near._nid").alias("nid"),
            F.col("_near._dist").alias("dist"),
        )
    )


def neighbor_columns(nearest_rows: DataFrame, keys: Sequence[str], k: int, prefix: str = "neighbor") -> DataFrame:
    """One row per point with its neighbour ids in columns ``prefix0`` .. ``prefix{k-1}``."""
    wide = nearest_rows.groupBy(*keys).pivot("rank", list(range(1, k + 1))).agg(F.first("nid"))
    return wide.withColumnsRenamed({str(r): f"{prefix}{r - 1}" for r in range(1, k + 1)})
