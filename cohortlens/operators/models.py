"""Classifiers and a feature selector on MLlib, with the settings the panel study compares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cohortlens.operators.dataset import assembler, min_max_scaler, standard_scaler


def gaussian_naive_bayes(label: str = "label", features: str = "features") -> NaiveBayes:
    return NaiveBayes(modelType="gaussian", labelCol=label, featuresCol=features)


def logistic_regression(
    label: str = "label", features: str = "features", reg: float = 0.0
) -> LogisticRegression:
    """Unpenalised by default; ``reg=1/rows`` corresponds to an L2 penalty with C = 1."""
    return LogisticRegression(labelCol=label, featuresCol=features, regParam=reg)


def random_forest(
    label: str = "label", features: str = "features", trees: int = 20, depth: int = 5, seed: int = 42
) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=label, featuresCol=features, numTrees=trees, maxDepth=depth, seed=seed
    )


def boosted_trees(
    label: str = "label",
    features: str = "features",
    rate: float = 0.1,
    rounds: int = 20,
    depth: int = 3,
    min_rows: int = 1,
    min_gain: float = 0.0,
    subsample: float = 1.0,
    column_share: float = 1.0,
    seed: int = 42,
) -> GBTClassifier:
    """Gradient-boosted trees; ``column_share`` is the share of features tried per node."""
    return GBTClassifier(
        labelCol=label,
        featuresCol=features,
        stepSize=rate,
        maxIter=rounds,
        maxDepth=depth,
        minInstancesPerNode=min_rows,
        minInfoGain=min_gain,
        subsamplingRate=subsample,
        featureSubsetStrategy="all" if column_share >= 1.0 else str(column_share),
        seed=seed,
    )


def network_layers(inputs: int, base: int = 20, add: int = 0, depth: int = 10) -> list[int]:
    """Layer sizes of a network whose hidden layers shrink in steps of ``base``."""
    return [inputs, *[m * base + add for m in range(depth, 0, -1)], 2]


def perceptron(
    layers: Sequence[int],
    label: str = "label",
    features: str = "features",
    solver: str = "gd",
    step: float = 0.03,
    rounds: int = 30,
    seed: int = 42,
) -> MultilayerPerceptronClassifier:
    """Feed-forward network; MLlib offers sigmoid hidden units and a softmax output."""
    return MultilayerPerceptronClassifier(
        layers=list(layers), labelCol=label, featuresCol=features, solver=solver,
        stepSize=step, maxIter=rounds, seed=seed,
    )


def lasso(alpha: float, label: str = "label", features: str = "features") -> LinearRegression:
    """Least squares with an L1 penalty on the 0/1 label."""
    return LinearRegression(
        labelCol=label, featuresCol=features, elasticNetParam=1.0, regParam=alpha, standardization=False
    )


def selected_features(model, names: Sequence[str]) -> list[str]:
    """Names whose coefficient the L1 penalty left away from zero."""
    return [n for n, c in zip(names, model.coefficients.toArray(), strict=True) if c != 0.0]


def with_features(
    estimator: Estimator, names: Sequence[str], scaling: str | None = "standard"
) -> Pipeline:
    """Assembler, optional scaler and classifier, all fitted on training rows only."""
    stages = [assembler(names, "features" if scaling is None else "raw_features")]
    if scaling == "standard":
        stages.append(standard_scaler("raw_features", "features"))
    elif scaling == "minmax":
        stages.append(min_max_scaler("raw_features", "features"))
    elif scaling is not None:
        raise ValueError(f"unknown scaling {scaling!r}")
    return Pipeline(stages=[*stages, estimator])


def fit(train: DataFrame, estimator: Estimator) -> Model:
    """Fit over cached training rows: iterative learners pass over them many times."""
    cached = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(cached)
    finally:
        cached.unpersist()


def score(model: Model, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Apply a model; keeps the named columns, the positive score and the predicted class."""
    scored = model.transform(rows)
    probability = vector_to_array(F.col("probability"))[1]
    return scored.select(
        *keep, probability.alias("score"), F.col("prediction").cast("int").alias("prediction")
    )


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
