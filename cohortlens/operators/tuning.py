"""Model selection: cross-validated scores, grids, staged grids and sweeps.

Only parameter settings and scores pass through the driver; rows stay distributed and every fit
is a Spark job.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cohortlens.operators.models import random_forest, with_features
from cohortlens.operators.lasso_path import lasso_path, moments
from cohortlens.operators.metrics import area_under_roc_by
from cohortlens.operators.scale import materialise, new_table_path


#: Values of a partition of a sweep's rows, at most; fits pass over few partitions of that size.
CELLS_A_PARTITION = 8_000_000
#: Penalties of the published lasso study: 25 in even steps (fixed values).
PENALTIES = tuple(round(0.0005 + 0.002 * i, 4) for i in range(25))


#: Grids of the published stage-wise tuning (fixed values): rate, rounds, depth and leaf size, gain,
#: row and column share; then both shares again in steps of a hundredth.
FULL_STAGES = (
    {"stepSize": [round(0.01 * i, 2) for i in range(1, 61)]},
    {"maxIter": list(range(100, 2001, 100))},
    {"maxDepth": list(range(3, 10)), "minInstancesPerNode": [1, 3, 5]},
    {"minInfoGain": [*[round(0.1 * i, 1) for i in range(16)], 2.0]},
    {"subsamplingRate": [0.6, 0.7, 0.8, 0.9, 1.0], "featureSubsetStrategy": [0.6, 0.7, 0.8, 0.9, 1.0]},
)
FULL_REFINE = {n: [-0.02, -0.01, 0.0, 0.01, 0.02] for n in ("subsamplingRate", "featureSubsetStrategy")}


def _auc(label: str) -> BinaryClassificationEvaluator:
    # Ranked by probability: naive Bayes keeps unnormalised likelihoods in its raw column.
    return BinaryClassificationEvaluator(
        labelCol=label, rawPredictionCol="probability", metricName="areaUnderROC", numBins=0
    )


def _classifier(estimator: Estimator) -> Estimator:
    return estimator.getStages()[-1] if isinstance(estimator, Pipeline) else estimator


def param_grid(estimator: Estimator, grid: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the named parameters of the classifier."""
    target = _classifier(estimator)
    names = list(grid)
    return [
        {target.getParam(n): v for n, v in zip(names, values)}
        for values in product(*[grid[n] for n in names])
    ]


def grid_search(
    df: DataFrame,
    estimator: Estimator,
    grid: Mapping[str, Sequence] | None = None,
    *,
    label: str = "label",
    folds: int = 5,
    fold_col: str | None = None,
    parallelism: int = 4,
    seed: int = 42,
) -> CrossValidatorModel:
    """Mean cross-validated area under ROC for every setting; refits the best one.

    ``fold_col`` fixes the folds, for instance by a hash of the entity key.
    """
    cv = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=param_grid(estimator, grid) if grid else [{}],
        evaluator=_auc(label),
        numFolds=folds,
        parallelism=parallelism,
        seed=seed,
        foldCol=fold_col or "",
    )
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cv.fit(cached)
    finally:
        cached.unpersist()


def grid_scores(model: CrossValidatorModel) -> list[dict]:
    """Settings and mean scores, in grid order."""
    return [
        {**{p.name: v for p, v in setting.items()}, "auc": float(auc)}
        for setting, auc in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]


def best_setting(model: CrossValidatorModel) -> dict:
    """Setting with the best score; the earlier one on a tie. A score that is no number raises."""
    scores = grid_scores(model)
    if any(math.isnan(s["auc"]) for s in scores):
        raise ValueError("a fold holds one class only, so its score is no number")
    return max(scores, key=lambda s: s["auc"])


def cross_validated_auc(df: DataFrame, estimator: Estimator, **options) -> float:
    """Mean area under ROC over the folds for one setting."""
    return float(grid_search(df, estimator, None, **options).avgMetrics[0])


def cross_validated_scores(
    df: DataFrame,
    cases: Mapping[str, Estimator],
    *,
    label: str = "label",
    fold_col: str = "fold",
    parallelism: int = 4,
) -> DataFrame:
    """``case``, ``fold``, ``label``, ``score`` of every row when its fold is held out, stored.

    Fits are Spark jobs, ``parallelism`` of them at a time; each writes its held-out scores into
    one table, so figures of all cases and folds come from one job over it.
    """
    spark = df.sparkSession
    path = new_table_path(spark, "cross-validated")
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        folds = sorted(r[0] for r in cached.select(fold_col).distinct().collect())
        names = list(cases)

        def one(task: tuple[int, int]) -> None:
            case, fold = task
            model = cases[names[case]].fit(cached.where(F.col(fold_col) != fold))
            held_out = model.transform(cached.where(F.col(fold_col) == fold))
            score = vector_to_array(F.col("probability"))[1]
            held_out = held_out.select(F.lit(names[case]).alias("case"), F.lit(fold).alias("fold"), F.col(label).cast("int").alias("label"), score.alias("score"))
            held_out.coalesce(1 + held_out.rdd.getNumPartitions() // 8).write.parquet(f"{path}/case={case}/fold={fold}")

        with ThreadPoolExecutor(parallelism) as pool:
            list(pool.map(inheritable_thread_target(spark)(one), product(range(len(names)), folds)))
    finally:
        cached.unpersist()
    files = [f"{path}/case={c}/fold={f}" for c in range(len(names)) for f in folds]
    return spark.read.schema("case string, fold int, label int, score double").parquet(*files)


def mean_auc(scores: DataFrame, case: str = "case", fold: str = "fold") -> DataFrame:
    """``case`` and its mean area under ROC over the folds, from one table of held-out scores.

    A fold with one class has no area and is left out of the mean.
    """
    per_fold = area_under_roc_by(scores, [case, fold])
    return per_fold.groupBy(case).agg(F.avg("auc").alias("auc"))


def best_key(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Key with the highest score; the smallest key on a tie."""
    return scores.agg(
        F.min_by(key, F.struct(-F.col(score), F.col(key))).alias(f"best_{key}"),
        F.max(score).alias(f"best_{score}"),
    )


def staged_tune(
    df: DataFrame,
    estimator: Estimator,
    stages: Sequence[Mapping[str, Sequence]] = FULL_STAGES,
    *,
    refine: Mapping[str, Sequence[float]] | None = FULL_REFINE,
    **options,
) -> tuple[dict, list[dict]]:
    """Tune group after group of parameters, keeping the best values found so far.

    ``refine`` adds a last grid of offsets around the values found, clipped to (0, 1].
    Returns the final setting and the winner of every stage.
    """
    chosen: dict = {}
    history = []
    todo = [dict(s) for s in stages]
    if refine:
        todo.append(dict(refine))
    for number, grid in enumerate(todo):
        if refine and number == len(todo) - 1:
            grid = {
                n: sorted({round(min(max(float(chosen[n]) + d, 0.01), 1.0), 6) for d in offsets})
                for n, offsets in grid.items()
                if n in chosen
            }
            if not grid:
                break
        typed = {n: [_as_param(estimator, n, v) for v in values] for n, values in grid.items()}
        fixed = {n: [_as_param(estimator, n, v)] for n, v in chosen.items() if n not in grid}
        best = best_setting(grid_search(df, estimator, {**fixed, **typed}, **options))
        chosen.update({n: best[n] for n in grid})
        history.append({"stage": number + 1, "auc": best["auc"], **{n: chosen[n] for n in grid}})
    return chosen, history


def _as_param(estimator: Estimator, name: str, value):
    """MLlib takes the per-node feature share as text; "1" would mean one feature, "1.0" all."""
    return str(float(value)) if name == "featureSubsetStrategy" and not isinstance(value, str) else value


def tabulate(spark: SparkSession, rows: Sequence[Mapping], schema: str) -> DataFrame:
    """Scores of a sweep as a small table."""
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def _gathered(stored: DataFrame, fits: int) -> DataFrame:
    """Stored rows in as few partitions as fill all cores when ``fits`` fits run at a time.

    An iterative fit starts a job for every pass, whose cost goes by its tasks. Larger tables keep
    more partitions, of at most about ``CELLS_A_PARTITION`` values each.
    """
    cells = stored.count() * len(stored.columns)
    return stored.coalesce(max(math.ceil(stored.sparkSession.sparkContext.defaultParallelism / fits), math.ceil(cells / CELLS_A_PARTITION)))


def sweep_neighbors(
    upto: DataFrame,
    base: DataFrame,
    keys: Sequence[str],
    own: Sequence[str],
    summarised: Sequence[str],
    ks: Sequence[int],
    estimator_for,
    *,
    label: str = "label",
    fold_col: str = "fold",
    parallelism: int = 4,
) -> DataFrame:
    """Cross-validated AUC per number of neighbours, all counts scored in one table.

    ``upto`` is the output of ``neighbor_features_upto``; ``base`` has keys, own features and
    label; ``k = 0`` uses the own features alone. Every k is scored on the same rows: those that
    have all features for every k.
    """
    known = upto.filter(F.col("k").isin([k for k in ks if k])).join(base.select(*keys), list(keys), "left_semi")
    wide = known.groupBy(*keys).pivot("k", sorted(k for k in ks if k))
    wide = wide.agg(*[F.first(c).alias(c) for c in summarised]) if any(ks) else None
    # Spark names a pivoted column by the value alone if there is one aggregate.
    column = {(k, c): f"{k}_{c}" if len(summarised) > 1 else str(k) for k in ks if k for c in summarised}
    data = base if wide is None else base.join(wide, list(keys))
    data = _gathered(materialise(data.na.drop(subset=[*own, *column.values()]), "sweep"), parallelism)
    cases = {str(k): estimator_for(list(own) + [column[k, c] for c in summarised if k]) for k in ks}
    scores = mean_auc(cross_validated_scores(data, cases, label=label, fold_col=fold_col, parallelism=parallelism))
    return materialise(scores.select(F.col("case").cast("int").alias("k"), "auc"), "sweep-scores")


def sweep_alpha(
    train: DataFrame,
    names: Sequence[str],
    alphas: Sequence[float],
    *,
    label: str = "label",
    trees: int = 20,
    seed: int = 42,
    fold_col: str = "fold",
    parallelism: int = 4,
) -> DataFrame:
    """Per L1 penalty: which features survive, and the AUC of a forest on the survivors.

    The whole path comes from one table of moments; forests are fitted once per set of survivors
    and fold, and scored in one table. A penalty that leaves no feature has no AUC.
    """
    path = lasso_path(moments(train, names, label), alphas)
    kept = {alpha: tuple(n for n, w in zip(names, weights) if w) for alpha, weights in path.items()}
    sets = sorted({k for k in kept.values() if k})
    cases = {str(i): with_features(random_forest(label, trees=trees, seed=seed), s, None) for i, s in enumerate(sets)}
    found = {}
    if cases:
        scores = cross_validated_scores(train, cases, label=label, fold_col=fold_col, parallelism=parallelism)
        found = {sets[int(r["case"])]: r["auc"] for r in mean_auc(scores).collect()}
    rows = [{"alpha": float(a), "kept": len(kept[float(a)]), "names": ",".join(kept[float(a)]), "auc": found.get(kept[float(a)])} for a in alphas]
    return tabulate(train.sparkSession, rows, "alpha double, kept int, names string, auc double")
