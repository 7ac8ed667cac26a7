"""Feed-forward networks with relu or tanh units, dropout and batch norm, trained by gradient sums.

The training rows are cut once into batches that do not depend on partitions. A step is one
pass over its batches: every task adds up the gradients of its own, the sums are added in two levels, and
only their total reaches the driver. Dropout is drawn by a hash of row, step and unit, so a task that is
run again draws the same units. Grids are searched by plain mini-batch descent over all rows outside a fold,
one task per fold and group of settings.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.boosting import row_draw
from cohortlens.operators.metrics import area_under_roc_by
from cohortlens.operators.scale import blocks_in_order, materialise, range_blocks

#: Grid of the published network study (fixed values): 72 points.
PUBLISHED_GRID = {
    "base": [10, 20],
    "depth": [1, 2, 3],
    "drop": [0.0, 0.01, 0.001],
    "norm_every": [0, 1],
    "activation": ["relu", "tanh"],
}
#: Sums of more partitions than this are added in a second level before they are collected.
GATHER = 64
#: Rows that are scored, or added up for their mean and spread, at a time.
ROWS_AT_A_TIME = 100_000
_NORM_FLOOR = 1e-3


@dataclass(frozen=True)
class NetworkSettings:
    """Shape and training of a network.

    ``depth`` hidden layers have ``m * base + add`` units for m = depth down to 1. Layers whose m
    is a multiple of ``norm_every`` are normalised by their batch (0: none). ``drop`` is the share
    of units left out after each layer, half of it after the one with m = 2. Two sigmoid outputs.
    """

    base: int = 20
    add: int = 0
    depth: int = 10
    drop: float = 0.0
    norm_every: int = 0
    activation: str = "relu"
    rate: float = 0.01
    epochs: int = 200
    batch: int = 32
    momentum: float = 0.99
    seed: int = 42

    def __post_init__(self) -> None:
        if self.activation not in ("relu", "tanh"):
            raise ValueError(f"unknown activation {self.activation!r}")
        if not 0 <= self.drop < 1 or self.batch < 1 or self.depth < 0:
            raise ValueError("drop must lie in [0, 1), batch be positive, depth not negative")

    def layers(self) -> list[tuple[int, bool, float]]:
        """(units, normalised, share left out) of each hidden layer."""
        multiples = range(self.depth, 0, -1)
        return [
            (m * self.base + self.add, self.norm_every > 0 and m % self.norm_every == 0, self.drop / 2 if m == 2 else self.drop)
            for m in multiples
        ]


@dataclass
class Network:
    """Weights of a network: per layer matrix and bias, then scale and shift of a normalised one.

    ``moving`` holds mean and variance of each normalised layer, used once training is over;
    ``center`` and ``spread`` scale the inputs.
    """

    settings: NetworkSettings
    features: list[str]
    weights: list[np.ndarray]
    moving: list[np.ndarray]
    center: np.ndarray
    spread: np.ndarray
    losses: list[float] = field(default_factory=list)


def new_network(settings: NetworkSettings, features: Sequence[str], center: Sequence[float] = (), spread: Sequence[float] = ()) -> Network:
    """A network with even random weights within the square root of 6 / (inputs + units)."""
    random = np.random.default_rng(settings.seed)
    weights, moving, width = [], [], len(features)
    for units, normalised, _ in [*settings.layers(), (2, False, 0.0)]:
        edge = math.sqrt(6 / (width + units))
        weights += [random.uniform(-edge, edge, (width, units)), np.zeros(units)]
        if normalised:
            weights += [np.ones(units), np.zeros(units)]
            moving += [np.zeros(units), np.ones(units)]
        width = units
    n = len(features)
    return Network(settings, list(features), weights, moving, np.array(center or [0.0] * n), np.array(spread or [1.0] * n))


def _left_in(draw: np.ndarray, step: int, layer: int, units: int, share: float | np.ndarray) -> np.ndarray:
    """Factor per row and unit (and share, if there are several): 0 for a unit left out, else 1 / (1 - share)."""
    mixed = draw.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(units, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    mixed += np.uint64((step * 1_000_003 + layer * 7919 + 1) * 0x8CB92BA72F3D8DD7 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    unit = (mixed >> np.uint64(11)).astype(float) / 2.0**53
    return (unit >= share) / (1 - share)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def gradients(
    net: Network, x: np.ndarray, y: np.ndarray, draw: np.ndarray, step: int, shares: Sequence[np.ndarray] | None = None
) -> tuple[float | np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sums over one batch: loss, gradients, and mean and variance of the normalised layers times rows.

    The loss of a row is the negative logarithm of its class's share of both outputs. With
    ``shares`` (per layer those left out), ``net`` holds several networks, stacked along a first axis
    (see :func:`fit_network_samples`), and so do the sums.
    """
    rows, settings, w = len(x), net.settings, net.weights
    several = shares is not None
    flipped = lambda m: m.swapaxes(-1, -2)
    held, a, at, batch_stats = [], x, 0, []
    for number, (units, normalised, share) in enumerate(settings.layers()):
        if several:
            share = shares[number]
        before = a
        z = a @ w[at] + w[at + 1]
        a = np.maximum(z, 0) if settings.activation == "relu" else np.tanh(z)
        slope = (z > 0).astype(float) if settings.activation == "relu" else 1 - a * a
        unit = deviation = factor = None
        if normalised:
            mean, variance = a.mean(-2, keepdims=several), a.var(-2, keepdims=several)
            deviation = np.sqrt(variance + _NORM_FLOOR)
            unit = (a - mean) / deviation
            a = unit * w[at + 2] + w[at + 3]
            batch_stats += [mean * rows, variance * rows]
        if np.any(share > 0):
            factor = _left_in(draw, step, number, units, share)
            a = a * factor
        held.append((at, before, slope, unit, deviation, factor))
        at += 4 if normalised else 2
    s = _sigmoid(a @ w[at] + w[at + 1])
    total = s.sum(-1) + 1e-300
    own = np.arange(2) == y[:, None].astype(int)
    loss = (np.log(total) - np.log((s * own).sum(-1) + 1e-300)).sum(-1)
    back = s * (1 - s) / total[..., None] - own * (1 - s)
    found: list[np.ndarray] = [np.empty(0)] * len(w)
    found[at], found[at + 1] = flipped(a) @ back, back.sum(-2, keepdims=several)
    if held:
        back = back @ flipped(w[at])
    for at, before, slope, unit, deviation, factor in reversed(held):
        if factor is not None:
            back = back * factor
        if unit is not None:
            found[at + 2], found[at + 3] = (back * unit).sum(-2, keepdims=several), back.sum(-2, keepdims=several)
            back = w[at + 2] / deviation * (back - found[at + 3] / rows - unit * found[at + 2] / rows)
        back = back * slope
        found[at], found[at + 1] = flipped(before) @ back, back.sum(-2, keepdims=several)
        if at:  # nobody asks for the gradient of the inputs
            back = back @ flipped(w[at])
    return loss if several else float(loss), found, batch_stats


def probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """Share of the second output of each row; normalised layers use the moving figures."""
    a, at, m = x, 0, 0
    for _, normalised, _ in net.settings.layers():
        z = a @ net.weights[at] + net.weights[at + 1]
        a = np.maximum(z, 0) if net.settings.activation == "relu" else np.tanh(z)
        at += 2
        if normalised:
            a = (a - net.moving[m]) / np.sqrt(net.moving[m + 1] + _NORM_FLOOR) * net.weights[at] + net.weights[at + 1]
            at, m = at + 2, m + 2
    s = _sigmoid(a @ net.weights[at] + net.weights[at + 1])
    return s[:, 1] / (s.sum(1) + 1e-300)


def _moved(net: Network, rows: float, sums: Sequence[np.ndarray], stats: Sequence[np.ndarray]) -> Network:
    """The network after one step along the mean gradient."""
    keep = net.settings.momentum
    weights = [w - net.settings.rate * g / rows for w, g in zip(net.weights, sums, strict=True)]
    moving = [keep * m + (1 - keep) * s / rows for m, s in zip(net.moving, stats, strict=True)]
    return replace(net, weights=weights, moving=moving)


def _mean_loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-300, 1)).mean())


class _Patience:
    """Keeps the network of the least loss; says when no better one came for ``rounds`` epochs."""

    def __init__(self, rounds: int):
        self.rounds, self.best, self.least, self.since = rounds, None, math.inf, 0

    def over(self, net: Network, loss: float) -> bool:
        if loss < self.least:
            self.best, self.least, self.since = net, loss, 0
        else:
            self.since += 1
        return self.since >= self.rounds


# --- all rows ----------------------------------------------------------------------------------------


def _scaled(features: Sequence[str], net: Network) -> Column:
    return F.array(*[(F.col(f"`{c}`").cast("double") - float(m)) / float(s) for c, m, s in zip(features, net.center, net.spread)])


def training_batches(rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], net: Network) -> DataFrame:
    """One row per batch: ``batch`` (0 up), ``x`` (flat, row after row), ``y``, ``draw``; stored.

    Rows are ordered by a hash of their key, then by their values, numbered across even range
    blocks, and cut every ``settings.batch`` rows, so batches are the same in any partitioning. A key on
    many rows is spread like any other.
    """
    drawn = rows.select(
        row_draw(keys, net.settings.seed).alias("draw"), _scaled(features, net).alias("x"), F.col(f"`{label}`").cast("double").alias("y"),
    ).withColumn("row", F.monotonically_increasing_id())
    order = ["draw", "x", "y", "row"]
    blocks = range_blocks(drawn, order)
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("_block").count().select("_block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1
    numbered = blocks.withColumn("at", inside).join(F.broadcast(starts), "_block").withColumn("at", F.col("at") + F.col("start"))
    listed = numbered.groupBy(F.floor(F.col("at") / net.settings.batch).alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct("at", "x", "y", "draw"))).alias("r")
    )
    return materialise(listed.select("batch", F.flatten("r.x").alias("x"), F.col("r.y").alias("y"), F.col("r.draw").alias("draw")), "batches")


def _flat(arrays: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays]) if len(arrays) else np.empty(0)


def _like(flat: np.ndarray, shapes: Sequence[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([a.size for a in shapes])
    return [flat[e - a.size : e].reshape(a.shape) for e, a in zip(ends, shapes)]


_SUMS = "slot long, rows long, loss double, sums binary"


def _step_sums(net: Network, batches: DataFrame, step: int) -> tuple[int, float, np.ndarray]:
    """Rows, loss and all sums of the batches; at most ``GATHER`` vectors reach the driver."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, loss, sums, slot = 0, 0.0, None, 0
        for part in parts:
            for number, x, y, draw in zip(part["batch"], part["x"], part["y"], part["draw"]):
                y = np.asarray(y)
                one, grads, stats = gradients(net, np.asarray(x).reshape(len(y), -1), y, np.asarray(draw), step)
                flat = _flat([*grads, *stats])
                rows, loss, slot = rows + len(y), loss + one, int(number) % GATHER
                sums = flat if sums is None else sums + flat
        if sums is not None:
            yield pd.DataFrame({"slot": [slot], "rows": [rows], "loss": [loss], "sums": [sums.tobytes()]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum([np.frombuffer(b) for b in group["sums"]], axis=0)
        return pd.DataFrame({"slot": group["slot"].iloc[:1], "rows": [group["rows"].sum()], "loss": [group["loss"].sum()], "sums": [sums.tobytes()]})

    found = batches.mapInPandas(add, _SUMS)
    if batches.rdd.getNumPartitions() > GATHER:
        found = found.groupBy("slot").applyInPandas(merge, _SUMS)
    parts = sorted(found.collect(), key=lambda r: r["slot"])
    if not parts:
        return 0, 0.0, np.empty(0)
    return sum(r["rows"] for r in parts), sum(r["loss"] for r in parts), np.sum([np.frombuffer(r["sums"]) for r in parts], axis=0)


def _held_out_loss(net: Network, batches: DataFrame) -> float:
    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for x, y in zip(part["x"], part["y"]):
                y = np.asarray(y)
                yield pd.DataFrame({"rows": [len(y)], "loss": [len(y) * _mean_loss(probabilities(net, np.asarray(x).reshape(len(y), -1)), y)]})

    total = batches.select("x", "y").mapInPandas(add, "rows long, loss double").agg(F.sum("loss") / F.sum("rows")).first()[0]
    return math.inf if total is None else total


def fit_network(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    settings: NetworkSettings = NetworkSettings(),
    *,
    steps: int = 1,
    start: Sequence[np.ndarray] | None = None,
    validation: DataFrame | None = None,
    patience: int = 15,
) -> Network:
    """A network fitted to all rows of ``train``: ``steps`` passes of an even share of the batches an epoch.

    Inputs are standardised by the training rows. Rows with a null feature or label are left out.
    A batch is normalised by its own rows, so results depend on ``settings.batch`` and never on
    partitions, but for the order of floating-point sums. With ``validation``, training ends after
    ``patience`` epochs without a smaller loss there and the best weights are returned. Without
    rows the starting weights are returned. ``start`` replaces the random ones.
    """
    train = train.na.drop(subset=[*features, label])
    figures = train.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"f{i}_{f.__name__}") for i, c in enumerate(features) for f in (F.avg, F.stddev_pop)]).first()
    net = new_network(settings, features, [v or 0.0 for v in figures[0::2]], [v or 1.0 for v in figures[1::2]])
    if start is not None:
        net = replace(net, weights=[np.array(w, float) for w in start])
    batches = training_batches(train, features, label, keys, net)
    held_out = None if validation is None else training_batches(validation.na.drop(subset=[*features, label]), features, label, keys, net)
    waiting = _Patience(patience)
    for epoch in range(settings.epochs):
        rows = loss = 0
        for part in range(steps):
            chosen = batches if steps == 1 else batches.where(F.col("batch") % steps == part)
            n, one, flat = _step_sums(net, chosen, epoch * steps + part)
            if n:
                weights = sum(w.size for w in net.weights)
                net = _moved(net, n, _like(flat[:weights], net.weights), _like(flat[weights:], net.moving))
            rows, loss = rows + n, loss + one
        if not rows:
            return net
        net = replace(net, losses=[*net.losses, loss / rows])
        if held_out is not None and waiting.over(net, _held_out_loss(net, held_out)):
            break
    return waiting.best or net


def score_network(net: Network, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The named columns, ``score`` of the positive class and ``prediction``; null where a feature is."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            whole = batch.notna().to_numpy()
            out = np.full(len(batch), np.nan)
            if whole.any():
                out[whole] = probabilities(net, np.stack(batch[whole].to_numpy()).astype(float))
            yield pd.Series([float(v) if w else None for v, w in zip(out, whole)], dtype="Float64")

    complete = F.forall("_x", lambda v: v.isNotNull())
    held = rows.select(*keep, _scaled(net.features, net).alias("_x")).withColumn("_x", F.when(complete, F.col("_x")))
    scored = held.withColumn("score", F.pandas_udf(score, "double")("_x"))
    return scored.select(*keep, "score", (F.col("score") > 0.5).cast("int").alias("prediction"))


# --- on arrays -----------------------------------------------------------------------------------------


@dataclass
class NetworkSample:
    """Rows as arrays, inputs not scaled."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    draw: np.ndarray


def _listed(rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], fold_col: str, seed: int) -> DataFrame:
    """Complete rows as ``draw``, ``x``, ``y`` and ``fold``."""
    return rows.na.drop(subset=[*features, label]).select(
        row_draw(keys, seed).alias("draw"), F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x"),
        F.col(f"`{label}`").cast("double").alias("y"), F.col(fold_col).alias("fold"),
    )


def network_sample(rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], fold_col: str, most: int, seed: int) -> NetworkSample:
    """Up to ``most`` complete rows with the smallest hash of their key."""
    found = _listed(rows, features, label, keys, fold_col, seed).orderBy("draw", "x", "y").limit(most).toPandas()
    x = np.stack(found["x"].to_numpy()) if len(found) else np.empty((0, len(features)))
    return NetworkSample(x, found["y"].to_numpy(float), found["fold"].to_numpy(int), found["draw"].to_numpy(np.int64))


def all_network_rows(rows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], fold_col: str, seed: int) -> NetworkSample:
    """Every complete row, by the hash of its key and its values."""
    parts = [NetworkSample(np.empty((0, len(features))), np.empty(0), np.empty(0, int), np.empty(0, np.int64))]
    for t in blocks_in_order(_listed(rows, features, label, keys, fold_col, seed), ["draw", "x", "y", "fold"]):
        x = t["x"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        parts.append(NetworkSample(x, *[t[c].to_numpy() for c in ("y", "fold", "draw")]))
    return NetworkSample(*[np.concatenate([getattr(p, n) for p in parts]) for n in ("x", "y", "fold", "draw")])


def _mean_and_spread(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each column over ``rows``, a part of them copied at a time."""
    parts = [rows[i : i + ROWS_AT_A_TIME] for i in range(0, len(rows), ROWS_AT_A_TIME)]
    mean = sum(x[p].sum(0) for p in parts) / len(rows)
    return mean, np.sqrt(sum(((x[p] - mean) ** 2).sum(0) for p in parts) / len(rows))


def _start_on_sample(x: np.ndarray, rows: np.ndarray, features: Sequence[str], settings: NetworkSettings) -> Network:
    """A new network that standardises by the given rows of ``x``."""
    mean, spread = _mean_and_spread(x, rows)
    return new_network(settings, features, mean.tolist(), np.where(spread > 0, spread, 1.0).tolist())


def _batches(net: Network, x: np.ndarray, y: np.ndarray, draw: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Standardised inputs, labels and draws of each batch of the rows in ``order``, of which 256 are copied at a time."""
    size = net.settings.batch
    for start in range(0, len(order), 256 * size):
        at = order[start : start + 256 * size]
        held = (x[at] - net.center) / net.spread, y[at], draw[at]
        for first in range(0, len(at), size):
            yield tuple(v[first : first + size] for v in held)


def fit_network_sample(
    x: np.ndarray, y: np.ndarray, draw: np.ndarray, features: Sequence[str], settings: NetworkSettings,
    validation: tuple[np.ndarray, np.ndarray] | None = None, patience: int = 15,
) -> Network:
    """The network of plain mini-batch descent: one step per batch, rows reordered every epoch."""
    if not len(x):
        return new_network(settings, features)
    net = _start_on_sample(x, np.arange(len(x)), features, settings)
    random = np.random.default_rng(settings.seed + 1)
    waiting, step = _Patience(patience), 0
    for _ in range(settings.epochs):
        order, total = random.permutation(len(x)), 0.0
        for batch in _batches(net, x, y, draw, order):
            loss, grads, stats = gradients(net, *batch, step)
            net, total, step = _moved(net, len(batch[1]), grads, stats), total + loss, step + 1
        net = replace(net, losses=[*net.losses, total / len(x)])
        if validation is not None:
            outside = probabilities(net, (validation[0] - net.center) / net.spread)
            if waiting.over(net, _mean_loss(outside, validation[1])):
                break
    return waiting.best or net


def fit_network_samples(
    x: np.ndarray, y: np.ndarray, draw: np.ndarray, features: Sequence[str], settings: Sequence[NetworkSettings], rows: np.ndarray | None = None,
) -> list[Network]:
    """What :func:`fit_network_sample` gives for each of ``settings``, which differ in ``drop`` alone.

    Such networks start alike and see the same batches, so they take each step together as one
    stack of matrices. ``rows`` are the places of the training rows, if not all; they are not copied.
    """
    one = replace(settings[0], drop=0.0)
    if any(replace(s, drop=0.0) != one for s in settings):
        raise ValueError("networks that are fitted together differ in drop alone")
    rows = np.arange(len(x)) if rows is None else rows
    if not len(rows):
        return [new_network(s, features) for s in settings]
    net = _start_on_sample(x, rows, features, one)
    several = lambda arrays: [np.stack([a.reshape(1, -1) if a.ndim == 1 else a] * len(settings)) for a in arrays]
    net = replace(net, weights=several(net.weights), moving=several(net.moving))
    shares = [np.array([share for _, _, share in layer]).reshape(-1, 1, 1) for layer in zip(*[s.layers() for s in settings])]
    random, step, losses = np.random.default_rng(one.seed + 1), 0, []
    for _ in range(one.epochs):
        order, total = rows[random.permutation(len(rows))], 0.0
        for batch in _batches(net, x, y, draw, order):
            loss, grads, stats = gradients(net, *batch, step, shares)
            net, total, step = _moved(net, len(batch[1]), grads, stats), total + loss, step + 1
        losses.append(total / len(rows))
    plain = new_network(one, features)
    shaped = lambda stack, like, i: [a[i].reshape(b.shape) for a, b in zip(stack, like)]
    return [
        replace(net, settings=s, weights=shaped(net.weights, plain.weights, i), moving=shaped(net.moving, plain.moving, i), losses=[float(v[i]) for v in losses])
        for i, s in enumerate(settings)
    ]


def tune_network(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    grid: Mapping[str, Sequence] = PUBLISHED_GRID,
    start: NetworkSettings = NetworkSettings(),
    *,
    fold_col: str = "fold",
) -> tuple[NetworkSettings, list[dict]]:
    """Every point of the grid with its mean area under ROC over the folds; the first wins a tie.

    One task per fold and group of settings that differ in ``drop`` alone, on all complete rows outside the
    fold; held-out scores of all of them go to one table, and one job gives the areas. The steps of a fit
    follow each other, so a fit stays in one task, and each Python process holds the rows once: 8 bytes a value.
    """
    spark = train.sparkSession
    held = all_network_rows(train, features, label, keys, fold_col, start.seed)
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    settings = [replace(start, **p) for p in points]
    alike: dict[NetworkSettings, list[int]] = {}
    for i, s in enumerate(settings):
        alike.setdefault(replace(s, drop=0.0), []).append(i)
    # The largest networks first, so that no long task begins last.
    groups = sorted(alike.values(), key=lambda g: -sum(w.size for w in new_network(settings[g[0]], features).weights))
    cases = [(g, int(f)) for g in range(len(groups)) for f in np.unique(held.fold)]
    if not cases:
        raise ValueError("no complete rows to tune on")
    shared, names = spark.sparkContext.broadcast(held), list(features)

    def fit_cases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for batch in batches:
            for g, fold in zip(batch["group"].tolist(), batch["fold"].tolist()):
                inside, outside = np.flatnonzero(s.fold != fold), np.flatnonzero(s.fold == fold)
                nets = fit_network_samples(s.x, s.y, s.draw, names, [settings[i] for i in groups[g]], inside)
                for first in range(0, len(outside), ROWS_AT_A_TIME):
                    at = outside[first : first + ROWS_AT_A_TIME]
                    for i, net in zip(groups[g], nets):
                        scores = probabilities(net, (s.x[at] - net.center) / net.spread)
                        yield pd.DataFrame({"setting": i, "fold": fold, "label": s.y[at].astype(int), "score": scores})

    tasks = spark.createDataFrame(spark.sparkContext.parallelize(cases, len(cases)), "group int, fold int")
    scores = materialise(tasks.mapInPandas(fit_cases, "setting int, fold int, label int, score double"), "networks")
    areas = area_under_roc_by(scores, ["setting", "fold"]).groupBy("setting").agg(F.avg("auc").alias("auc"))
    found = {r["setting"]: r["auc"] for r in areas.collect()}
    history = [{**p, "auc": found.get(i)} for i, p in enumerate(points)]
    best = max((i for i in found if found[i] is not None), key=lambda i: (found[i], -i))
    return settings[best], history


def fit_network_in_task(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], settings: NetworkSettings) -> Network:
    """The network of :func:`fit_network_sample` on all complete rows, fitted in one task; rows in the order of :func:`all_network_rows`."""
    spark, names = train.sparkSession, list(features)
    shared = spark.sparkContext.broadcast(all_network_rows(train.withColumn("_fold", F.lit(0)), features, label, keys, "_fold", settings.seed))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            s = shared.value
            yield pd.DataFrame({"net": [pickle.dumps(fit_network_sample(s.x, s.y, s.draw, names, settings))]})

    return pickle.loads(spark.range(0, 1, 1, 1).mapInPandas(fit, "net binary").collect()[0]["net"])
