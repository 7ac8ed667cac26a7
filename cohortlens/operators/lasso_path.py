"""L1-penalised least squares for many penalties from one table of moments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Means and deviations of features, correlations among them and covariances with the label."""

    names: list[str]
    means: np.ndarray
    deviations: np.ndarray
    correlation: np.ndarray
    covariance: np.ndarray
    label_mean: float


def standardised(names: Sequence[str], means: Sequence[float], deviations: Sequence[float]) -> list[Column]:
    """Features centred and divided by their deviation; a constant one becomes 0."""
    return [
        (F.col(n).cast("double") - float(m)) / float(d) if d > 0 else F.lit(0.0)
        for n, m, d in zip(names, means, deviations, strict=True)
    ]


def moments(rows: DataFrame, names: Sequence[str], label: str = "label") -> Moments:
    """Two passes over complete rows: means and deviations, then products of the centred columns.

    A table of features by features reaches the driver, whatever the number of rows. Deviations
    are those of the rows themselves (divided by n). No rows give zeros.
    """
    first = rows.agg(
        *[F.avg(F.col(n).cast("double")).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(F.col(n).cast("double")).alias(f"s{i}") for i, n in enumerate(names)],
        F.avg(F.col(label).cast("double")).alias("y"),
    ).first()
    k = len(names)
    means = np.array([first[f"m{i}"] or 0.0 for i in range(k)])
    deviations = np.array([first[f"s{i}"] or 0.0 for i in range(k)])
    z = standardised(names, means, deviations)
    y = F.col(label).cast("double") - float(first["y"] or 0.0)
    held = rows.select(*[c.alias(f"z{i}") for i, c in enumerate(z)], y.alias("y"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    second = held.agg(
        *[F.avg(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs], *[F.avg(F.col(f"z{i}") * F.col("y")) for i in range(k)]
    ).first()
    values = [v or 0.0 for v in second]
    correlation = np.zeros((k, k))
    for (i, j), v in zip(pairs, values):
        correlation[i, j] = correlation[j, i] = v
    return Moments(list(names), means, deviations, correlation, np.array(values[len(pairs) :]), first["y"] or 0.0)


def lasso_path(m: Moments, alphas: Sequence[float], tolerance: float = 1e-12, most_rounds: int = 100_000) -> dict[float, np.ndarray]:
    """Weights of the standardised features per penalty, least squares halved and divided by n.

    Coordinate descent on the moments from the largest penalty down, each starting at the weights
    of the one before. Raises if a penalty does not settle in ``most_rounds`` rounds.
    """
    weights = np.zeros(len(m.names))
    path = {}
    own = np.diag(m.correlation)
    for alpha in sorted(alphas, reverse=True):
        for _ in range(most_rounds):
            change = 0.0
            for j in range(len(weights)):
                if own[j] <= 0:
                    continue
                rest = m.covariance[j] - m.correlation[j] @ weights + own[j] * weights[j]
                new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / own[j]
                change = max(change, abs(new - weights[j]))
                weights[j] = new
            if change < tolerance:
                break
        else:
            raise RuntimeError(f"the weights for penalty {alpha} do not settle")
        path[float(alpha)] = weights.copy()
    return path


def path_table(rows: DataFrame, m: Moments, path: dict[float, np.ndarray]) -> DataFrame:
    """``alpha``, ``feature``, ``weight``, ``kept`` for every penalty, the smallest first."""
    listed = [
        (alpha, n, float(w), bool(w != 0)) for alpha, weights in sorted(path.items()) for n, w in zip(m.names, weights)
    ]
    return rows.sparkSession.createDataFrame(listed, "alpha double, feature string, weight double, kept boolean")


def optimality(rows: DataFrame, m: Moments, path: dict[float, np.ndarray], label: str = "label", slack: float = 1e-8) -> DataFrame:
    """``alpha``, ``feature``, ``optimal``: the conditions of the minimum, from the rows themselves.

    The mean product of feature and residual is the penalty with the weight's sign where a
    feature is kept, and at most the penalty where it is not. All penalties in one pass.
    """
    z = F.array(*standardised(m.names, m.means, m.deviations))
    y = F.col(label).cast("double") - float(m.label_mean)
    held = rows.select(z.alias("z"), y.alias("y"))
    fits = [F.lit(0.0) + sum((F.col("z")[i] * float(w) for i, w in enumerate(ws) if w), start=F.lit(0.0)) for ws in path.values()]
    held = held.select("z", F.array(*[F.col("y") - f for f in fits]).alias("left"))
    products = [F.avg(F.col("left")[a] * F.col("z")[i]) for a in range(len(path)) for i in range(len(m.names))]
    found = held.agg(F.array(*products).alias("g")).first()["g"]
    listed = []
    for a, (alpha, ws) in enumerate(path.items()):
        for i, (n, w) in enumerate(zip(m.names, ws)):
            g = found[a * len(m.names) + i] or 0.0
            ok = abs(g - alpha * np.sign(w)) <= slack if w else abs(g) <= alpha + slack
            listed.append((float(alpha), n, bool(ok)))
    return rows.sparkSession.createDataFrame(listed, "alpha double, feature string, optimal boolean")
