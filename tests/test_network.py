"""Networks: gradients against differences, sums over partitions, early stopping, the grid."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from cohortlens.operators import network
from cohortlens.operators.dataset import fold_column
from cohortlens.operators.network import NetworkSettings

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 500
    y = rng.integers(0, 2, n)
    return pd.DataFrame({"id": np.arange(n), "a": rng.normal(1.5 * y), "b": 40 + 9 * rng.normal(-y), "c": rng.normal(size=n), "label": y})


@pytest.fixture(scope="module")
def rows(spark, frame):
    return fold_column(spark.createDataFrame(frame), ["id"], 3).cache()


@pytest.mark.parametrize("activation", ["relu", "tanh"])
@pytest.mark.parametrize("norm_every, drop", [(0, 0.0), (1, 0.0), (2, 0.3), (0, 0.4)])
def test_gradients_equal_differences(activation, norm_every, drop):
    rng = np.random.default_rng(1)
    net = network.new_network(NetworkSettings(base=3, add=1, depth=3, drop=drop, norm_every=norm_every, activation=activation), NAMES)
    # Away from zero biases, where relu has a corner for a row whose units are all left out.
    net = replace(net, weights=[w + rng.normal(0, 0.1, w.shape) for w in net.weights])
    x, y, draw = rng.normal(size=(12, 3)), rng.integers(0, 2, 12), rng.integers(0, 2**31, 12)
    _, found, _ = network.gradients(net, x, y, draw, 4)
    for k, w in enumerate(net.weights):
        for at in list(np.ndindex(w.shape))[:8]:
            sides = []
            for move in (1e-6, -1e-6):
                other = [v.copy() for v in net.weights]
                other[k][at] += move
                sides.append(network.gradients(replace(net, weights=other), x, y, draw, 4)[0])
            assert found[k][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=2e-4)


def test_dropout_leaves_the_share_out_and_repeats():
    draw = np.arange(4000)
    once = network._left_in(draw, 3, 1, 20, 0.25)
    assert abs((once == 0).mean() - 0.25) < 0.01 and once.max() == pytest.approx(4 / 3)
    assert np.array_equal(once, network._left_in(draw, 3, 1, 20, 0.25))
    assert not np.array_equal(once, network._left_in(draw, 4, 1, 20, 0.25))


def test_shapes_and_dropout_follow_the_multiples():
    assert NetworkSettings(base=10, add=1, depth=3, drop=0.2, norm_every=2).layers() == [(31, False, 0.2), (21, True, 0.1), (11, False, 0.2)]
    assert len(list(network.product(*network.PUBLISHED_GRID.values()))) == 72
    with pytest.raises(ValueError):
        NetworkSettings(activation="sigmoid")


def test_a_fit_does_not_depend_on_partitions(rows):
    settings = NetworkSettings(base=4, depth=2, drop=0.1, norm_every=1, rate=0.2, epochs=3, batch=16)
    one = network.fit_network(rows.repartition(1), NAMES, "label", ["id"], settings, steps=2)
    many = network.fit_network(rows.repartition(7, "c"), NAMES, "label", ["id"], settings, steps=2)
    for a, b in zip([*one.weights, *one.moving], [*many.weights, *many.moving]):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_sums_in_two_levels_are_the_same(rows, monkeypatch):
    net = network.new_network(NetworkSettings(base=4, depth=1), NAMES)
    batches = network.training_batches(rows, NAMES, "label", ["id"], net).repartition(5)
    n, loss, sums = network._step_sums(net, batches, 0)
    monkeypatch.setattr(network, "GATHER", 2)
    again = network._step_sums(net, batches, 0)
    assert n == again[0] == 500 and loss == pytest.approx(again[1])
    np.testing.assert_allclose(sums, again[2])


def test_one_step_is_the_mean_gradient_of_all_rows(rows, frame):
    settings = NetworkSettings(base=3, depth=1, activation="tanh", rate=0.5, epochs=1)
    net = network.fit_network(rows, NAMES, "label", ["id"], settings)
    x = ((frame[NAMES] - frame[NAMES].mean()) / frame[NAMES].std(ddof=0)).to_numpy()
    start = network.new_network(settings, NAMES)
    loss, grads, _ = network.gradients(start, x, frame["label"].to_numpy(), np.zeros(500, int), 0)
    assert net.losses == [pytest.approx(loss / 500)]
    for got, w, g in zip(net.weights, start.weights, grads):
        np.testing.assert_allclose(got, w - 0.5 * g / 500, atol=1e-9)


def test_batches_hold_every_row_once_though_a_key_repeats(spark):
    same = spark.range(400).select(F.lit(1).alias("id"), (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 2).alias("label"))
    net = network.new_network(NetworkSettings(batch=32), ["a"])
    batches = network.training_batches(same, ["a"], "label", ["id"], net).toPandas()
    assert sorted(batches["batch"]) == list(range(13))
    assert sorted(len(y) for y in batches["y"]) == [16] + 12 * [32]
    assert sum(map(sum, batches["x"])) == 800


def test_training_separates_the_classes_and_scores_like_numpy(rows, frame):
    settings = NetworkSettings(base=6, depth=1, rate=0.5, epochs=25)
    net = network.fit_network(rows, NAMES, "label", ["id"], settings, steps=2)
    scored = network.score_network(net, rows, ["id", "label"]).toPandas().sort_values("id")
    x = (frame[NAMES].to_numpy() - net.center) / net.spread
    np.testing.assert_allclose(scored["score"], network.probabilities(net, x))
    assert net.losses[-1] < net.losses[0] and (scored["prediction"] == scored["label"]).mean() > 0.8


def test_early_stopping_returns_the_best_weights(rows, frame):
    settings = NetworkSettings(base=4, depth=1, rate=0.5, epochs=12)
    wrong = rows.withColumn("label", 1 - F.col("label"))
    net = network.fit_network(rows, NAMES, "label", ["id"], settings, validation=wrong, patience=2)
    assert len(net.losses) <= 3
    x, y, draw = frame[NAMES].to_numpy(), frame["label"].to_numpy(), frame["id"].to_numpy()
    stopped = network.fit_network_sample(x, y, draw, NAMES, settings, (x, 1 - y), patience=2)
    assert len(stopped.losses) <= 3


def test_nulls_constant_features_and_empty_tables(spark, rows):
    odd = rows.withColumn("same", F.lit(2.0)).withColumn("a", F.when(F.col("id") % 9 > 0, F.col("a")))
    net = network.fit_network(odd, [*NAMES, "same"], "label", ["id"], NetworkSettings(base=2, depth=1, epochs=2))
    scored = network.score_network(net, odd, ["id"])
    assert scored.where(F.col("score").isNull()).count() == odd.where("a is null").count()
    assert scored.where(F.col("score").isNull() != F.col("prediction").isNull()).count() == 0
    none = network.fit_network(rows.limit(0), NAMES, "label", ["id"], NetworkSettings(base=2, depth=1, epochs=2))
    assert none.losses == [] and network.score_network(none, rows.limit(0), ["id"]).count() == 0
    with pytest.raises(ValueError):
        network.tune_network(rows.limit(0), NAMES, "label", ["id"], {"base": [2]})


def test_the_grid_is_scored_fold_by_fold(spark, rows, frame):
    grid = {"base": [2, 4], "activation": ["relu", "tanh"]}
    start = NetworkSettings(depth=1, epochs=6, rate=0.05)
    chosen, history = network.tune_network(rows, NAMES, "label", ["id"], grid, start)
    folds = rows.orderBy("id").toPandas()["fold"].to_numpy()
    draws = rows.orderBy("id").select(network.row_draw(["id"], 42).alias("d")).toPandas()["d"].to_numpy()
    order = np.argsort(draws, kind="stable")
    x, y, fold, draw = frame[NAMES].to_numpy()[order], frame["label"].to_numpy(float)[order], folds[order], draws[order]
    for point in history:
        areas = []
        for f in range(3):
            inside = fold != f
            net = network.fit_network_sample(x[inside], y[inside], draw[inside], NAMES, replace(start, base=point["base"], activation=point["activation"]))
            scores = network.probabilities(net, (x[~inside] - net.center) / net.spread)
            table = spark.createDataFrame(pd.DataFrame({"label": y[~inside], "rawPrediction": scores}))
            areas.append(BinaryClassificationEvaluator(numBins=0).evaluate(table))
        assert point["auc"] == pytest.approx(np.mean(areas))
    best = max(history, key=lambda h: h["auc"])
    assert (chosen.base, chosen.activation) == (best["base"], best["activation"])


def test_networks_fitted_together_equal_those_fitted_alone(frame):
    x, y, draw = frame[NAMES].to_numpy(float), frame["label"].to_numpy(float), np.arange(len(frame)) * 7919 + 1
    shape = NetworkSettings(base=4, depth=3, norm_every=2, activation="tanh", epochs=4)
    alike = [replace(shape, drop=d) for d in (0.0, 0.3, 0.05)]
    for one, together in zip(alike, network.fit_network_samples(x, y, draw, NAMES, alike)):
        alone = network.fit_network_sample(x, y, draw, NAMES, one)
        assert together.settings == one and together.losses == pytest.approx(alone.losses)
        for a, b in zip([*together.weights, *together.moving], [*alone.weights, *alone.moving], strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(network.probabilities(together, x), network.probabilities(alone, x), rtol=1e-9)
    with pytest.raises(ValueError, match="drop alone"):
        network.fit_network_samples(x, y, draw, NAMES, [shape, replace(shape, base=5)])
    assert len(network.fit_network_samples(x[:0], y[:0], draw[:0], NAMES, alike)) == 3


def test_the_grid_and_the_winner_see_every_row(spark, monkeypatch):
    n, settings = 4_500, NetworkSettings(base=2, depth=1, epochs=1)
    many = spark.range(n).select("id", *[(F.col("id") * k % 89).cast("double").alias(c) for k, c in ((1, "a"), (5, "b"), (11, "c"))], (F.col("id") % 89 > 40).cast("int").alias("label"))
    many, counted, area = fold_column(many, ["id"], 2).cache(), [], network.area_under_roc_by
    monkeypatch.setattr(network, "area_under_roc_by", lambda scores, by: counted.extend(scores.groupBy("setting").count().collect()) or area(scores, by))
    network.tune_network(many, NAMES, "label", ["id"], {"drop": [0.0, 0.1]}, settings)
    assert [r["count"] for r in counted] == [n] * 2
    net = network.fit_network_in_task(many, NAMES, "label", ["id"], settings)
    values = many.select(NAMES).toPandas().to_numpy()
    np.testing.assert_allclose(net.center, values.mean(0))
    np.testing.assert_allclose(net.spread, values.std(0))


def test_training_rows_are_named_by_their_places(frame, monkeypatch):
    x, y, draw = frame[NAMES].to_numpy(float), frame["label"].to_numpy(float), np.arange(len(frame)) * 7919 + 1
    alike, rows = [NetworkSettings(base=3, depth=1, epochs=2, drop=d) for d in (0.0, 0.2)], np.flatnonzero(draw % 3)
    for one, other in zip(network.fit_network_samples(x, y, draw, NAMES, alike, rows), network.fit_network_samples(x[rows], y[rows], draw[rows], NAMES, alike)):
        assert all((a == b).all() for a, b in zip([*one.weights, one.center, one.spread], [*other.weights, other.center, other.spread]))
    whole = network._mean_and_spread(x, rows)
    monkeypatch.setattr(network, "ROWS_AT_A_TIME", 7)
    for a, b in zip(whole, network._mean_and_spread(x, rows)):
        np.testing.assert_allclose(a, b)
