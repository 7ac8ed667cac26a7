"""Second-order boosted trees over binned features.

Each round fits a tree to the gradients and hessians of the logistic loss. A level of a tree
needs nothing but their sums per (node, feature, bin), so :func:`fit_boosted` counts them within
each task, adds them up by one aggregation, and only those sums, bounded by the settings, reach
the driver.
:func:`fit_sample` runs the same rounds on arrays; tuning uses it inside tasks, one per setting and fold, each
on all rows outside the fold. Rows too many for a task's memory are tuned by :func:`fit_boosted`, which gives
the same trees but where rounding decides between equal gains.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.dataset import hash_fraction
from cohortlens.operators.metrics import area_under_roc_by
from cohortlens.operators.scale import blocks_in_order, materialise, new_table_path

#: Bins up to which all rows go to every tuning task, at a byte each for up to 256 bins; beyond, each fit is spread.
TASK_CELLS = 2**27
#: Rounds after which the margins of a distributed fit are written, which cuts their lineage.
ROUNDS_A_WRITE = 5
_PRIME = 2**31 - 1
_STEP = 48271


@dataclass(frozen=True)
class BoostSettings:
    """What the published study tunes.

    ``rate`` shrinks every tree, ``least_weight`` is the least sum of hessians in a leaf,
    ``least_gain`` what a split must gain at least, ``row_share`` and ``column_share`` the shares
    of rows and features that a tree sees, ``penalty`` the squared penalty on leaf weights.
    """

    rate: float = 0.1
    rounds: int = 100
    depth: int = 3
    least_weight: float = 1.0
    least_gain: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    penalty: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order (children of i are 2i + 1 and 2i + 2); feature -1 marks a leaf or a gap."""

    feature: np.ndarray
    cut: np.ndarray
    weight: np.ndarray


@dataclass
class BoostedModel:
    """Trees over the bins of named features."""

    features: list[str]
    edges: list[list[float]]
    settings: BoostSettings
    trees: list[Tree] = field(default_factory=list)


# --- binning --------------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = 32) -> list[list[float]]:
    """At most ``bins`` - 1 different cuts per feature, at even shares of the rows."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in features]).first()
    return [sorted(set(found[c] or [])) for c in features]


def binned(rows: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], keep: Sequence[str | Column]) -> DataFrame:
    """``keep`` and ``bins``: per feature the number of cuts at or below the value."""
    inf = float("inf")
    names = [f"_bin{i}" for i in range(len(features))]
    # A feature without a cut gets one that nothing reaches.
    splits = [[-inf, *(e or [1.7976931348623157e308]), inf] for e in edges]
    doubles = rows.withColumns({n: F.col(c).cast("double") for n, c in zip(names, features)})
    outputs = [f"{n}_out" for n in names]
    cut = Bucketizer(splitsArray=splits, inputCols=names, outputCols=outputs, handleInvalid="error").transform(doubles)
    return cut.select(*keep, F.array(*[F.col(n).cast("int") for n in outputs]).alias("bins"))


# --- one tree --------------------------------------------------------------------------------------


def _columns_of_round(settings: BoostSettings, width: int, number: int) -> np.ndarray:
    """Features that tree ``number`` may split on."""
    count = max(1, round(settings.column_share * width))
    if count >= width:
        return np.arange(width)
    return np.sort(np.random.default_rng((settings.seed, number)).choice(width, count, replace=False))


def _multiplier(settings: BoostSettings, number: int) -> int:
    return pow(_STEP, settings.seed + number + 1, _PRIME)


def _rows_limit(settings: BoostSettings) -> int:
    return int(settings.row_share * _PRIME)


def best_splits(sums: np.ndarray, settings: BoostSettings, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the best feature (-1: none), its cut, and the node's weight.

    ``sums`` is (node, feature, bin, 2): gradients and hessians. A cut c sends bins up to c to the
    left. Equal gains go to the first feature, then the lowest cut. ``allowed`` says per node which
    features may split it.
    """
    total, weight = _totals(sums, settings)
    left_g, left_h = (np.cumsum(sums[..., i], axis=2)[:, :, :-1] for i in (0, 1))
    right_h = total[:, None, None, 1] - left_h
    enough = (left_h >= settings.least_weight) & (right_h >= settings.least_weight)
    if allowed is not None:
        enough &= allowed[:, :, None]
    gain = np.full((len(sums), enough[0].size if len(sums) else 0), -np.inf)
    if gain.shape[1] == 0:
        return np.full(len(sums), -1), np.zeros(len(sums), np.int64), weight

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return _over(g**2, h, settings)

    # Only cuts that leave enough on both sides are worked out.
    at = np.flatnonzero(enough)
    node = at // gain.shape[1]
    left_g, left_h, right_h = left_g.ravel()[at], left_h.ravel()[at], right_h.ravel()[at]
    both = score(left_g, left_h) + score(total[node, 0] - left_g, right_h)
    # Sums run in another order on a cluster; what is equal but for rounding must stay equal.
    gain.ravel()[at] = np.round(0.5 * (both - score(total[:, 0], total[:, 1])[node]) - settings.least_gain, 9)
    place = gain.argmax(axis=1)
    splits = gain[np.arange(len(sums)), place] > 0
    feature, cut = np.divmod(place, enough.shape[2])
    return np.where(splits, feature, -1), np.where(splits, cut, 0), weight


def _over(top: np.ndarray, hessian: np.ndarray, settings: BoostSettings) -> np.ndarray:
    """0 where a node has neither rows nor a penalty."""
    bottom = hessian + settings.penalty
    return np.divide(top, bottom, out=np.zeros_like(top), where=bottom > 0)


def _totals(sums: np.ndarray, settings: BoostSettings) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of each node, by the bins of its first feature, and its weight."""
    total = np.cumsum(sums[:, 0], axis=1)[:, -1]
    return total, -_over(total[:, 0], total[:, 1], settings)


def grow_tree(histogram: Callable[[list[int], Tree, np.ndarray], np.ndarray], columns: np.ndarray, settings: BoostSettings) -> Tree:
    """One tree, level by level. ``histogram(nodes, tree, columns)`` gives the sums of open nodes.

    The last level is not split, so it asks for one feature, whose bins give the weights.
    """
    slots = 2 ** (settings.depth + 1) - 1
    tree = Tree(np.full(slots, -1), np.zeros(slots, np.int64), np.zeros(slots))
    nodes = [0]
    for level in range(settings.depth + 1):
        if level == settings.depth:
            tree.weight[nodes] = settings.rate * _totals(histogram(nodes, tree, columns[:1]), settings)[1]
            break
        feature, cut, weight = best_splits(histogram(nodes, tree, columns), settings)
        tree.weight[nodes] = settings.rate * weight
        chosen = feature >= 0
        split = np.array(nodes)[chosen]
        tree.feature[split], tree.cut[split] = columns[feature[chosen]], cut[chosen]
        nodes = [c for i in split.tolist() for c in (2 * i + 1, 2 * i + 2)]
        if not nodes:
            break
    return tree


def tree_nodes(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """Node of each row after all splits so far."""
    at = np.zeros(len(bins), np.int64)
    while _step_down(tree, bins, at):
        pass
    return at


def _step_down(tree: Tree, bins: np.ndarray, at: np.ndarray) -> bool:
    """Moves each row at a split node to its child, in ``at``; whether any row moved."""
    feature = tree.feature[at]
    moving = feature >= 0
    if not moving.any():
        return False
    rows = np.arange(len(bins)) if moving.all() else np.flatnonzero(moving)
    node = at[rows]
    at[rows] = 2 * node + 1 + (bins[rows, feature[rows]] > tree.cut[node])
    return True


# --- on arrays -------------------------------------------------------------------------------------


def fit_sample(bins: np.ndarray, label: np.ndarray, draw: np.ndarray, settings: BoostSettings, width: int) -> list[Tree]:
    """Trees for rows held as arrays; ``width`` is the largest number of bins of a feature.

    ``draw`` has a number in 0 .. 2^31 - 2 per row that decides in which rounds the row is drawn.
    Sums are counted feature by feature, so that a count's few cells stay in the processor's cache; rows that a
    tree does not draw are left out once a tree.
    """
    margin, trees, by_feature = np.zeros(len(bins)), [], np.ascontiguousarray(bins.T)
    for number in range(settings.rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - label, p * (1 - p)
        drawn = np.flatnonzero(draw * _multiplier(settings, number) % _PRIME < _rows_limit(settings))
        columns = _columns_of_round(settings, bins.shape[1], number)
        at = np.zeros(len(bins), np.int64)  # node of each row so far
        held, weights = [by_feature[c][drawn] for c in columns], [x[drawn] for x in (gradient, hessian)]

        def histogram(nodes: list[int], tree: Tree, columns: np.ndarray) -> np.ndarray:
            if nodes != [0]:
                _step_down(tree, bins, at)
            place = np.full(len(tree.feature), -1)
            place[nodes] = np.arange(len(nodes))
            node = place[at[drawn]]
            inside = node >= 0
            sums = np.zeros((2, len(nodes), len(columns), width))

            def count(features: range, rows: np.ndarray) -> None:
                chosen = slice(None) if rows.all() else np.flatnonzero(rows)
                first, weighted = node[chosen] * width, [w[chosen] for w in weights]
                for f in features:
                    key = first + held[f][chosen]
                    for side, w in zip(sums, weighted):
                        side[:, f] = np.bincount(key, weights=w, minlength=len(nodes) * width).reshape(len(nodes), width)

            count(range(1), inside)
            if len(columns) > 1:
                # Whoever has no weight for two leaves cannot be split, so its other features need no sums.
                large = sums[1, :, 0].sum(axis=1) >= 2 * settings.least_weight * (1 - 1e-9)
                count(range(1, len(columns)), inside if large.all() else inside & large[node])
            return np.moveaxis(sums, 0, -1)

        tree = grow_tree(histogram, columns, settings)
        trees.append(tree)
        _step_down(tree, bins, at)
        margin += tree.weight[at]
    return trees


def margins_after(trees: Sequence[Tree], bins: np.ndarray, rounds: Sequence[int]) -> np.ndarray:
    """Margin of each row after each of the ascending ``rounds``: one pass over the trees."""
    margin, out, done = np.zeros(len(bins)), [], 0
    for upto in rounds:
        for tree in trees[done:upto]:
            margin = margin + tree.weight[tree_nodes(tree, bins)]
        done = upto
        out.append(margin)
    return np.stack(out, axis=1)


# --- on all rows -----------------------------------------------------------------------------------


def _node_column(tree: Tree) -> Column:
    """Node of a row as a nested condition over ``bins``."""

    def below(i: int) -> Column:
        if tree.feature[i] < 0:
            return F.lit(i)
        return F.when(F.col("bins")[int(tree.feature[i])] <= int(tree.cut[i]), below(2 * i + 1)).otherwise(below(2 * i + 2))

    return below(0)


def _weight_column(tree: Tree) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in tree.weight]), _node_column(tree) + 1)


def _margin_column(trees: Sequence[Tree]) -> Column:
    """The margin of a row after ``trees`` that it lacks."""
    margin = F.col("margin")
    for tree in trees:
        margin = margin + _weight_column(tree)
    return margin


def row_draw(keys: Sequence[str], seed: int) -> Column:
    """Number in 0 .. 2^31 - 2 from a hash of the key."""
    return F.floor(hash_fraction(keys, f"draw-{seed}") * (_PRIME - 1)).cast("long")


def fit_boosted(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], settings: BoostSettings = BoostSettings(), bins: int = 32, edges: list[list[float]] | None = None) -> BoostedModel:
    """Boosted trees over all rows of ``train``; complete features, labels 0 and 1.

    A level costs one pass over the rows; each task hands on at most 2^depth * features * bins
    sums, and as many reach the driver. If a row lacks a feature, rows are spread out per feature
    instead. ``edges`` gives the cuts, else they lie at even shares of
    the rows. Margins are written every ``ROUNDS_A_WRITE`` rounds. Without rows, all trees are
    single leaves of weight 0.
    """
    edges = edges or bin_edges(train, features, bins)
    bins = max(bins, *(len(e) + 1 for e in edges))
    model = BoostedModel(list(features), edges, settings)
    rows = binned(train, features, edges, [F.col(label).cast("double").alias("y"), row_draw(keys, settings.seed).alias("draw")])
    rows = materialise(rows.withColumn("margin", F.lit(0.0)), "boost")
    incomplete = not rows.where(F.exists("bins", F.isnull)).isEmpty()
    for number in range(settings.rounds):
        unwritten = model.trees[number - number % ROUNDS_A_WRITE :]
        if number and not unwritten:
            rows = materialise(rows.withColumn("margin", _margin_column(model.trees[-ROUNDS_A_WRITE:])), "boost")

        def histogram(nodes: list[int], tree: Tree, columns: np.ndarray) -> np.ndarray:
            if incomplete:
                return _spread_sums(rows, nodes, [*unwritten, tree], columns, settings, number, bins)
            sums = np.zeros((len(columns), len(nodes), bins, 2))
            counted = level_sums(rows, nodes, [*unwritten, tree], columns, settings, number, bins)
            for r in counted.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.reshape(-1, 2)[r["cell"]] = r["g"], r["h"]
            return np.moveaxis(sums, 0, 1)

        model.trees.append(grow_tree(histogram, _columns_of_round(settings, len(features), number), settings))
    return model


def level_sums(rows: DataFrame, nodes: Sequence[int], trees: Sequence[Tree], columns: np.ndarray, settings: BoostSettings, number: int, bins: int) -> DataFrame:
    """``cell``, ``g`` and ``h``: gradients and hessians of round ``number`` per (feature, node, bin).

    ``rows`` has y, draw, bins and margin; ``trees`` are those that the margins lack, and last the
    one being grown. Cells are counted within each task: rows are not repeated per feature, a task
    hands on one row per cell at most, and no plan is compiled anew for a tree.
    """
    *unwritten, tree = trees
    place = np.full(len(tree.feature), -1)
    place[list(nodes)] = np.arange(len(nodes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(columns), len(nodes) * bins))
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, -1)
            margin = batch.column("margin").to_numpy()
            for t in unwritten:
                margin = margin + t.weight[tree_nodes(t, held)]
            p = 1 / (1 + np.exp(-margin))
            y, known = (c.to_numpy(zero_copy_only=False) for c in (batch.column("y"), batch.column("y").is_valid()))
            gradient, hessian = np.where(known, p - y, 0.0), p * (1 - p)
            drawn = batch.column("draw").to_numpy() * _multiplier(settings, number) % _PRIME < _rows_limit(settings)
            at = place[tree_nodes(tree, held)]
            inside = np.flatnonzero(drawn & (at >= 0))
            first, weights = at[inside] * bins, [x[inside] for x in (gradient, hessian)]
            for f, c in enumerate(columns):
                cell = first + held[inside, c]
                for side, w in zip(sums, weights):
                    side[f] += np.bincount(cell, weights=w, minlength=side.shape[1])
        g, h = sums.reshape(2, -1)
        cells = np.flatnonzero((g != 0) | (h != 0))
        yield pa.RecordBatch.from_pydict({"cell": cells, "g": g[cells], "h": h[cells]})

    return rows.mapInArrow(count, "cell long, g double, h double")


def _spread_sums(rows: DataFrame, nodes: Sequence[int], trees: Sequence[Tree], columns: np.ndarray, settings: BoostSettings, number: int, bins: int) -> np.ndarray:
    """Sums per (node, feature, bin) of rows of which some lack a feature, one row per feature."""
    *unwritten, tree = trees
    sums = np.zeros((len(nodes), len(columns), bins, 2))
    place = {n: i for i, n in enumerate(nodes)}
    p = 1 / (1 + F.exp(-F.col("margin")))
    drawn = F.pmod(F.col("draw") * _multiplier(settings, number), F.lit(_PRIME)) < _rows_limit(settings)
    held = rows.withColumn("margin", _margin_column(unwritten)).where(drawn).select("bins", (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h"))
    entries = F.posexplode(F.array(*[F.col("bins")[int(c)] for c in columns])).alias("feature", "bin")
    spread = held.withColumn("node", _node_column(tree)).where(F.col("node").isin(list(nodes))).select("node", "g", "h", entries)
    for r in spread.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        sums[place[r["node"]], r["feature"], r["bin"]] = r["g"], r["h"]
    return sums


def score_boosted(model: BoostedModel, rows: DataFrame, keep: Sequence[str], rounds: Sequence[int] | None = None) -> DataFrame:
    """``keep``, ``rounds``, ``score`` and ``prediction`` after each of ``rounds`` (default: all trees).

    One pass gives the scores of every prefix of the model.
    """
    upto = sorted(rounds or [len(model.trees)])
    trees = model.trees

    @F.pandas_udf("array<double>")
    def margins(binned_rows: pd.Series) -> pd.Series:
        if not len(binned_rows):
            return pd.Series([], dtype=object)
        return pd.Series(list(margins_after(trees, np.stack(binned_rows.to_numpy()).astype(np.int64), upto)), dtype=object)

    spread = binned(rows, model.features, model.edges, list(keep)).withColumn("margins", margins(F.col("bins")))
    numbered = F.posexplode("margins").alias("at", "margin")
    scored = spread.select(*keep, numbered).withColumn("score", 1 / (1 + F.exp(-F.col("margin"))))
    of_place = F.array(*[F.lit(r) for r in upto])[F.col("at")]
    return scored.select(*keep, of_place.alias("rounds"), "score", (F.col("score") > 0.5).cast("int").alias("prediction"))


# --- tuning ----------------------------------------------------------------------------------------

#: Grids of the published stage-wise tuning (fixed values): rate, rounds, depth and leaf weight, gain,
#: row and column share; then both shares again in steps of a hundredth.
PUBLISHED_STAGES = (
    {"rate": [round(0.01 * i, 2) for i in range(1, 61)]},
    {"rounds": list(range(100, 2001, 100))},
    {"depth": list(range(3, 10)), "least_weight": [1.0, 3.0, 5.0]},
    {"least_gain": [*[round(0.1 * i, 1) for i in range(16)], 2.0]},
    {"row_share": [0.6, 0.7, 0.8, 0.9, 1.0], "column_share": [0.6, 0.7, 0.8, 0.9, 1.0]},
)
PUBLISHED_REFINE = {n: [-0.02, -0.01, 0.0, 0.01, 0.02] for n in ("row_share", "column_share")}
#: Where the published tuning starts.
PUBLISHED_START = BoostSettings(rate=0.1, rounds=100, depth=3, least_weight=1.0, least_gain=1.0, row_share=0.8)


@dataclass
class Sample:
    """Rows as arrays; bins in the smallest type that holds them."""

    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    draw: np.ndarray
    width: int


def all_rows(rows: DataFrame) -> Sample:
    """Every row, by draw and values, as arrays; ``rows`` has y, fold, draw, bins, and no row lacks a bin."""
    order = ["draw", "hash", "y", "fold"]
    parts: list[Sample] = []
    for t in blocks_in_order(rows.withColumn("hash", F.xxhash64("bins")), order):
        flat = t["bins"].combine_chunks().flatten()
        if flat.null_count or t["bins"].null_count:
            raise ValueError("a row lacks a feature")
        bins = flat.to_numpy().reshape(t.num_rows, -1)
        kept = bins.astype(np.min_scalar_type(int(bins.max())))
        parts.append(Sample(kept, *[t[c].to_numpy() for c in ("y", "fold", "draw")], int(bins.max()) + 1))
    if not parts:
        raise ValueError("no rows to fit on")
    bins, y, fold, draw = (np.concatenate([getattr(p, n) for p in parts]) for n in ("bins", "label", "fold", "draw"))
    return Sample(bins, y.astype(float), fold.astype(int), draw.astype(np.int64), max(p.width for p in parts))


def _one_setting(sample: Sample, settings: BoostSettings, fold: int, rounds: Sequence[int]) -> pd.DataFrame:
    """Held-out scores of one fold after each number of rounds."""
    inside, outside = sample.fold != fold, sample.fold == fold
    trees = fit_sample(sample.bins[inside], sample.label[inside], sample.draw[inside], settings, sample.width)
    margins = margins_after(trees, sample.bins[outside], rounds)
    n = int(outside.sum())
    return pd.DataFrame({
        "rounds": np.tile(rounds, n), "label": np.repeat(sample.label[outside].astype(int), len(rounds)), "score": margins.ravel(),
    })


def cross_validated_scores(spark, sample: Sample, settings: Sequence[BoostSettings], rounds: Sequence[int] | None = None) -> DataFrame:
    """``setting`` (its number), ``rounds``, ``fold``, ``label``, ``score`` of every held-out row, stored.

    One task per setting and fold; all rows of ``sample`` go to each, once a Python process. With
    ``rounds`` given, one fit of the largest number gives the scores of all of them.
    """
    listed = list(settings)
    cases = [(i, int(f)) for i in range(len(listed)) for f in np.unique(sample.fold)]
    shared = spark.sparkContext.broadcast(sample)

    def fit_cases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, fold in zip(batch["setting"].tolist(), batch["fold"].tolist()):
                chosen = listed[i] if rounds is None else replace(listed[i], rounds=max(rounds))
                scores = _one_setting(shared.value, chosen, fold, sorted(rounds) if rounds else [chosen.rounds])
                yield scores.assign(setting=i, fold=fold)[["setting", "fold", "rounds", "label", "score"]]

    # One partition per case: by hash, some tasks would get several.
    tasks = spark.createDataFrame(spark.sparkContext.parallelize(cases, len(cases)), "setting int, fold int")
    return materialise(tasks.mapInPandas(fit_cases, "setting int, fold int, rounds int, label int, score double"), "tuning")


def spread_scores(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], edges: list[list[float]], settings: Sequence[BoostSettings], rounds: Sequence[int] | None = None, fold_col: str = "fold", bins: int = 32) -> DataFrame:
    """What :func:`cross_validated_scores` gives, for any number of rows: one fit after another, each spread by :func:`fit_boosted`."""
    path = new_table_path(train.sparkSession, "tuning")
    folds = [r[0] for r in train.select(fold_col).distinct().orderBy(fold_col).collect()]
    for i, fold in product(range(len(settings)), folds):
        chosen = settings[i] if rounds is None else replace(settings[i], rounds=max(rounds))
        model = fit_boosted(train.where(F.col(fold_col) != fold), features, label, keys, chosen, bins, edges)
        scored = score_boosted(model, train.where(F.col(fold_col) == fold), [label], rounds)
        found = scored.select(F.lit(i).alias("setting"), F.lit(fold).cast("int").alias("fold"), "rounds", F.col(label).cast("int").alias("label"), "score")
        found.write.mode("append").parquet(path)
    return train.sparkSession.read.parquet(path)


def mean_auc(scores: DataFrame) -> list[dict]:
    """Mean over the folds of the area under ROC per (setting, rounds), in order, from one table."""
    per_fold = area_under_roc_by(scores, ["setting", "rounds", "fold"])
    means = per_fold.groupBy("setting", "rounds").agg(F.avg("auc").alias("auc")).orderBy("setting", "rounds")
    return [r.asDict() for r in means.collect()]


def _fits_a_task(train: DataFrame, features: Sequence[str]) -> bool:
    return train.count() * len(features) <= TASK_CELLS


def _scores_in_tasks(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], edges: list[list[float]], fold_col: str, seed: int) -> Callable[..., DataFrame] | None:
    """:func:`cross_validated_scores` on all rows of ``train``; None if they do not fit a task."""
    if not _fits_a_task(train, features):
        return None
    kept = [F.col(label).cast("double").alias("y"), F.col(fold_col).alias("fold"), row_draw(keys, seed).alias("draw")]
    rows = all_rows(binned(train, features, edges, kept))
    return lambda settings, rounds=None: cross_validated_scores(train.sparkSession, rows, settings, rounds)


def staged_boosting(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    *,
    stages: Sequence[Mapping[str, Sequence]] = PUBLISHED_STAGES,
    refine: Mapping[str, Sequence[float]] | None = PUBLISHED_REFINE,
    start: BoostSettings = PUBLISHED_START,
    fold_col: str = "fold",
    bins: int = 32,
) -> tuple[BoostSettings, list[dict]]:
    """Tune group after group of parameters by cross-validated area under ROC over all rows.

    Each stage keeps the best values found so far; the first setting wins a tie. ``refine`` adds
    a last grid of offsets around the values found, at most 1. A stage that varies ``rounds``
    alone costs one fit a fold. Up to ``TASK_CELLS`` bins, one task makes one fit on all its rows;
    beyond, each fit is spread over the cluster. Returns the final settings and the winner of every stage.
    """
    edges = bin_edges(train, features, bins)
    scores = _scores_in_tasks(train, features, label, keys, edges, fold_col, start.seed)
    if scores is None:
        scores = lambda settings, rounds=None: spread_scores(train, features, label, keys, edges, settings, rounds, fold_col, bins)
    chosen, history = start, []
    todo = [dict(s) for s in stages] + ([None] if refine else [])
    for number, grid in enumerate(todo, 1):
        if grid is None:
            grid = {n: sorted({round(min(max(getattr(chosen, n) + d, 0.01), 1.0), 6) for d in offsets}) for n, offsets in refine.items()}
        if list(grid) == ["rounds"]:
            settings, rounds = [chosen], sorted(grid["rounds"])
            found = mean_auc(scores(settings, rounds))
            best = max(found, key=lambda r: (r["auc"], -r["rounds"]))
            chosen = replace(chosen, rounds=best["rounds"])
        else:
            settings = [replace(chosen, **dict(zip(grid, values))) for values in product(*grid.values())]
            found = mean_auc(scores(settings))
            best = max(found, key=lambda r: (r["auc"], -r["setting"]))
            chosen = settings[best["setting"]]
        history.append({"stage": number, "tried": len(found), "auc": best["auc"], **{n: getattr(chosen, n) for n in grid}})
    return chosen, history


def fit_in_task(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], settings: BoostSettings, bins: int = 32) -> BoostedModel:
    """The model of :func:`fit_boosted`, on all rows too, its rounds run in one task if the rows fit there."""
    edges = bin_edges(train, features, bins)
    if not _fits_a_task(train, features):
        return fit_boosted(train, features, label, keys, settings, bins, edges)
    kept = [F.col(label).cast("double").alias("y"), F.lit(0).alias("fold"), row_draw(keys, settings.seed).alias("draw")]
    shared = train.sparkSession.sparkContext.broadcast(all_rows(binned(train, features, edges, kept)))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            s = shared.value
            yield pd.DataFrame({"trees": [pickle.dumps(fit_sample(s.bins, s.label, s.draw, settings, s.width))]})

    found = train.sparkSession.range(0, 1, 1, 1).mapInPandas(fit, "trees binary").collect()
    return BoostedModel(list(features), edges, settings, pickle.loads(found[0]["trees"]))


#: The same under its name from when it took a part of the rows.
fit_on_sample = fit_in_task
