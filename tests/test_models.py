"""Models and tuning within seeded bounds."""

import numpy as np
import pytest

from cohortlens.operators import metrics, models, tuning
from cohortlens.operators.dataset import fold_column

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(600):
        y = int(rng.random() < 0.4)
        data.append((i, float(rng.normal(2 * y, 1)), float(rng.normal(y, 1)), float(rng.normal()), y))
    return fold_column(spark.createDataFrame(data, "id int, a double, b double, c double, label int"), ["id"], 3).cache()


@pytest.mark.parametrize(
    "make, scaling",
    [
        (models.gaussian_naive_bayes, None),
        (models.logistic_regression, "minmax"),
        (models.random_forest, None),
        (lambda: models.boosted_trees(rounds=3), None),
        (lambda: models.perceptron(models.network_layers(3, base=8, depth=1), solver="l-bfgs"), "standard"),
    ],
)
def test_models_learn(rows, make, scaling):
    train, test = rows.filter("id < 450"), rows.filter("id >= 450")
    model = models.fit(train, models.with_features(make(), NAMES, scaling))
    assert metrics.evaluate(model.transform(test), "areaUnderROC") > 0.85
    scored = models.score(model, test, ["id", "label"])
    assert scored.columns == ["id", "label", "score", "prediction"]
    assert scored.filter("score < 0 or score > 1").count() == 0


def test_network_shapes():
    assert models.network_layers(27) == [27, 200, 180, 160, 140, 120, 100, 80, 60, 40, 20, 2]
    assert models.network_layers(4, base=10, add=1, depth=2) == [4, 21, 11, 2]


def test_lasso_drops_noise(rows):
    model = models.fit(rows, models.with_features(models.lasso(0.05), NAMES))
    kept = models.selected_features(model.stages[-1], NAMES)
    assert "a" in kept and "c" not in kept


def test_saved_model_scores_the_same(rows, tmp_path):
    model = models.fit(rows, models.with_features(models.logistic_regression(), NAMES))
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    a = models.score(model, rows, ["id"]).orderBy("id").toPandas()
    b = models.score(again, rows, ["id"]).orderBy("id").toPandas()
    assert a.equals(b)


def test_grid_and_staged_search(rows):
    lr = models.with_features(models.logistic_regression(), NAMES)
    found = tuning.grid_search(rows, lr, {"regParam": [0.0, 5.0], "elasticNetParam": [0.0, 1.0]}, folds=3, fold_col="fold")
    scores = tuning.grid_scores(found)
    assert len(scores) == 4 and tuning.best_setting(found)["auc"] == max(s["auc"] for s in scores)
    gbt = models.with_features(models.boosted_trees(rounds=2, depth=2), NAMES, None)
    chosen, history = tuning.staged_tune(
        rows, gbt, [{"stepSize": [0.1, 0.5]}, {"subsamplingRate": [0.8]}],
        refine={"subsamplingRate": [-0.02, 0.02]}, folds=3, fold_col="fold",
    )
    assert set(chosen) == {"stepSize", "subsamplingRate"} and chosen["subsamplingRate"] in (0.78, 0.82)
    assert [h["stage"] for h in history] == [1, 2, 3]


def test_penalty_sweep(rows):
    got = tuning.sweep_alpha(rows, NAMES, [0.001, 10.0], trees=3).collect()
    assert got[0]["kept"] >= 2 and got[0]["auc"] > 0.8
    assert got[1]["kept"] == 0 and got[1]["auc"] is None


def test_best_key_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([(3, 0.9), (1, 0.9), (2, 0.5)], "k int, auc double")
    assert tuple(tuning.best_key(df, "k", "auc").first()) == (1, 0.9)
