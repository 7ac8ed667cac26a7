"""Bagged trees whose rows are drawn by a hash of the key, so a forest does not depend on partitions.

All trees grow together: a level of the whole forest is one aggregation of row weights and
weighted labels per (tree, node, feature, bin). Splits lower the variance of the 0/1 label, which
is the same as lowering its Gini impurity.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.boosting import BoostSettings, Tree, best_splits, bin_edges, binned, row_draw, tree_nodes
from cohortlens.operators.scale import materialise

_PRIME = 2**31 - 1
_STEP = 48271
#: Shares of rows drawn at most 0, 1, 2, ... times in a bag of as many draws as rows (Poisson with mean 1).
TIMES = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


@dataclass(frozen=True)
class ForestSettings:
    """``features_a_node`` of the features (0: the root of their number) compete at each node."""

    trees: int = 20
    depth: int = 5
    least_weight: float = 1.0
    features_a_node: int = 0
    seed: int = 42


@dataclass
class ForestModel:
    features: list[str]
    edges: list[list[float]]
    settings: ForestSettings
    trees: list[Tree] = field(default_factory=list)


def _multipliers(settings: ForestSettings) -> list[int]:
    return [pow(_STEP, settings.seed + t + 1, _PRIME) for t in range(settings.trees)]


def _bag_weights(settings: ForestSettings) -> Column:
    """How often each tree draws the row."""
    drawn = []
    for m in _multipliers(settings):
        place = F.pmod(F.col("draw") * m, F.lit(_PRIME)) / float(_PRIME)
        drawn.append(sum(((place >= t).cast("int") for t in TIMES[1:]), start=(place >= TIMES[0]).cast("int")))
    return F.array(*drawn)


def _allowed(settings: ForestSettings, tree: int, nodes: Sequence[int], width: int) -> np.ndarray:
    """Which features compete at each node."""
    count = settings.features_a_node or max(1, round(width**0.5))
    allowed = np.zeros((len(nodes), width), bool)
    for i, node in enumerate(nodes):
        allowed[i, np.random.default_rng((settings.seed, tree, node)).choice(width, min(count, width), replace=False)] = True
    return allowed


def _next_nodes(trees: Sequence[Tree], level: int) -> Column:
    """Node of the row in every tree after the splits of ``level``."""
    first, last = 2**level - 1, 2 ** (level + 1) - 1
    table = lambda name: F.array(*[F.array(*[F.lit(int(x)) for x in getattr(t, name)[first:last]]) for t in trees])
    features, cuts = table("feature"), table("cut")

    def step(node: Column, tree: Column) -> Column:
        inside = (node >= first) & (node < last)
        place = F.greatest(node - first, F.lit(0)) % (last - first)
        feature, cut = features[tree][place], cuts[tree][place]
        right = F.when(F.get(F.col("bins"), feature) > cut, 1).otherwise(0)
        return F.when(inside & (feature >= 0), 2 * node + 1 + right).otherwise(node)

    return F.transform("nodes", step)


def fit_forest(
    train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], settings: ForestSettings = ForestSettings(),
    bins: int = 32, edges: list[list[float]] | None = None,
) -> ForestModel:
    """A forest over all rows of ``train``; complete features, labels 0 and 1.

    ``depth`` + 1 aggregations; of each at most trees * 2^level * features * bins sums reach the
    driver. Rows with equal keys are drawn together. Without rows every tree is a leaf of 0.
    """
    edges = edges or bin_edges(train, features, bins)
    bins = max(len(e) + 1 for e in edges)
    model = ForestModel(list(features), edges, settings)
    slots = 2 ** (settings.depth + 1) - 1
    model.trees = [Tree(np.full(slots, -1), np.zeros(slots, np.int64), np.zeros(slots)) for _ in range(settings.trees)]
    rows = binned(train, features, edges, [F.col(label).cast("double").alias("y"), row_draw(keys, settings.seed).alias("draw")])
    rows = rows.select("y", "bins", _bag_weights(settings).alias("weights"), F.array_repeat(F.lit(0), settings.trees).alias("nodes"))
    rows = materialise(rows, "forest")
    split = BoostSettings(rate=1.0, depth=settings.depth, least_weight=settings.least_weight, penalty=0.0)
    open_nodes = {t: [0] for t in range(settings.trees)}
    for level in range(settings.depth + 1):
        each = F.posexplode(F.arrays_zip("weights", "nodes")).alias("tree", "at")
        spread = rows.select("y", "bins", each).select("y", "bins", "tree", F.col("at.weights").alias("w"), F.col("at.nodes").alias("node"))
        # Rows in leaves of earlier levels have smaller node numbers.
        spread = spread.where((F.col("w") > 0) & (F.col("node") >= 2**level - 1))
        spread = spread.select("tree", "node", "w", (F.col("w") * F.col("y")).alias("wy"), F.posexplode("bins").alias("feature", "bin"))
        found = spread.groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")).toPandas()
        for t, part in found.groupby("tree"):
            tree, nodes = model.trees[t], open_nodes.get(t, [])
            place = np.full(slots, -1)
            place[nodes] = np.arange(len(nodes))
            sums = np.zeros((len(nodes), len(features), bins, 2))
            where = place[part["node"].to_numpy()], part["feature"].to_numpy(), part["bin"].to_numpy()
            sums[(*where, 0)], sums[(*where, 1)] = -part["wy"], part["w"]
            feature, cut, weight = best_splits(sums, split, _allowed(settings, t, nodes, len(features)))
            tree.weight[nodes] = weight
            chosen = (feature >= 0) & (level < settings.depth)
            parents = np.array(nodes)[chosen]
            tree.feature[parents], tree.cut[parents] = feature[chosen], cut[chosen]
            open_nodes[t] = [c for i in parents.tolist() for c in (2 * i + 1, 2 * i + 2)]
        if level == settings.depth or not any(open_nodes.values()):
            break
        rows = materialise(rows.withColumn("nodes", _next_nodes(model.trees, level)), "forest")
    return model


def score_forest(model: ForestModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, ``score`` (mean share of 1 over the trees) and ``prediction``."""
    trees = model.trees

    @F.pandas_udf("double")
    def share(binned_rows: pd.Series) -> pd.Series:
        if not len(binned_rows):
            return pd.Series([], dtype=float)
        bins = np.stack(binned_rows.to_numpy()).astype(np.int64)
        return pd.Series(np.mean([t.weight[tree_nodes(t, bins)] for t in trees], axis=0))

    scored = binned(rows, model.features, model.edges, list(keep)).withColumn("score", share(F.col("bins")))
    return scored.select(*keep, "score", (F.col("score") > 0.5).cast("int").alias("prediction"))
