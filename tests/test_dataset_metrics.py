"""Splits, balancing, scaling and metrics."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlens.operators import dataset, metrics, profile


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(4000).withColumns({
        "year": (F.col("id") % 6 + 2010).cast("int"),
        "label": F.when(F.col("id") % 10 == 0, 1).otherwise(0),
    })


def test_hash_split_is_a_partition_of_the_rows(people):
    train, test = dataset.hash_split(people, ["id", "year"])
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    assert not a & b and len(a | b) == 4000
    assert 0.77 < len(a) / 4000 < 0.83
    again, _ = dataset.hash_split(people.repartition(3), ["id", "year"])
    assert {r["id"] for r in again.collect()} == a


def test_undersampling_balances_and_is_seeded(people):
    train, _ = dataset.hash_split(people, ["id"])
    kept = dataset.undersample(train, "label", ["id"])
    balance = profile.class_ratio(kept, "label").first()
    assert balance["positives"] == train.filter("label = 1").count()
    assert 0.8 < balance["ratio"] < 1.25
    assert {r["id"] for r in kept.collect()} == {r["id"] for r in dataset.undersample(train.repartition(5), "label", ["id"]).collect()}


def test_folds_are_even_inside_a_training_split(people):
    train, _ = dataset.hash_split(people, ["id"])
    sizes = dataset.fold_column(train, ["id"], 5).groupBy("fold").count().toPandas().set_index("fold")["count"]
    assert sorted(sizes.index) == [0, 1, 2, 3, 4] and sizes.min() > 0.8 * sizes.mean()


def test_scaling_is_fitted_on_train(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0), (5.0, 8.0)], "a double, b double")
    train, other = df.filter("b = 5"), df.filter("b = 8")
    fitted = dataset.fit_scaling(train, ["a"], "minmax")
    assert fitted.transform(train).count() == 2
    values = [r["a"] for r in dataset.unpack_vector(fitted.transform(train), "scaled", ["a"], []).collect()]
    assert min(values) == 0.0 and max(values) == 1.0
    assert dataset.unpack_vector(fitted.transform(other), "scaled", ["a"], []).first()["a"] == 2.0


PAIRS = [(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 4


def test_known_confusion(spark):
    df = spark.createDataFrame(PAIRS, "label int, prediction int")
    cells = {(r["label"], r["prediction"]): r["rows"] for r in metrics.confusion(df).collect()}
    assert cells == {(1, 1): 3, (1, 0): 2, (0, 1): 1, (0, 0): 4}
    m = metrics.class_metrics(df).first()
    assert m["precision_1"] == pytest.approx(3 / 4) and m["recall_1"] == pytest.approx(3 / 5)
    assert m["precision_0"] == pytest.approx(4 / 6) and m["recall_0"] == pytest.approx(4 / 5)
    assert m["accuracy"] == pytest.approx(0.7)


def test_metrics_equal_mllib(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(600):
        y = int(rng.random() < 0.3)
        p = float(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0.01, 0.99).round(2))
        rows.append((float(y), float(p > 0.5), p, Vectors.dense(1 - p, p), Vectors.dense(1 - p, p)))
    df = spark.createDataFrame(rows, ["label", "prediction", "score", "rawPrediction", "probability"]).cache()
    m = metrics.class_metrics(df).first()
    for ours, theirs in {
        "precision_1": "precision", "recall_1": "recall", "accuracy": "accuracy",
        "weighted_precision": "weightedPrecision", "weighted_recall": "weightedRecall", "weighted_f1": "f1",
    }.items():
        assert m[ours] == pytest.approx(metrics.evaluate(df, theirs)), ours
    assert metrics.area_under_roc(df).first()["auc"] == pytest.approx(metrics.evaluate(df, "areaUnderROC"))
    assert metrics.log_loss(df).first()["log_loss"] == pytest.approx(metrics.evaluate(df, "logLoss"))


def test_auc_of_one_repeated_score(spark):
    df = spark.createDataFrame([(i % 2, 0.5) for i in range(100)], "label int, score double")
    assert metrics.area_under_roc(df).first()["auc"] == 0.5


def test_slices_outcomes_and_residuals(spark):
    df = spark.createDataFrame([(y, p, i) for i, (y, p) in enumerate(PAIRS)], "label int, prediction int, i int")
    got = {r["slice"]: r for r in metrics.slice_metrics(df, {"all": F.lit(True), "few": F.col("i") < 5, "none": F.col("i") < 0}).collect()}
    assert got["all"]["precision"] == pytest.approx(0.75) and got["few"]["recall"] == pytest.approx(0.6)
    assert got["none"]["precision"] is None
    kinds = {r["outcome"]: r["count"] for r in metrics.outcome(df).groupBy("outcome").count().collect()}
    assert kinds == {"hit": 3, "missed": 2, "other": 5}
    rest = {r["residual"]: r["rows"] for r in metrics.residual_profile(df, ["i"]).collect()}
    assert rest == {-1: 2, 0: 7, 1: 1}


def test_positive_class(spark):
    df = spark.createDataFrame([([0.2, 0.8],), ([0.5, 0.5],), ([0.9, 0.1],)], "s array<double>")
    assert [r[0] for r in df.select(metrics.positive_class(F.col("s"))).collect()] == [1, 0, 0]


def test_describe(spark):
    df = spark.createDataFrame([(float(v), None if v == 3 else v) for v in range(1, 6)], "a double, b int")
    got = {r["column"]: r for r in profile.describe(df, ["a", "b"]).collect()}
    assert (got["a"]["q25"], got["a"]["q50"], got["a"]["q75"]) == (2.0, 3.0, 4.0)
    assert got["b"]["count"] == 4 and got["b"]["max"] == 5.0
    assert profile.null_counts(df).first()["b"] == 1
    assert profile.distinct_count(df, "b", approx=True).first()["distinct_values"] == 4
