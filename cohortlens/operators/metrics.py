"""Classification metrics computed as aggregations over a scored table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.scale import range_blocks


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction)."""
    return (
        df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"))
        .agg(F.count("*").alias("rows"))
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per label, one column per prediction of a two-class problem."""
    hit = F.col(prediction).cast("int")
    return df.groupBy(F.col(label).cast("int").alias("label")).agg(
        F.count_if(hit == 0).alias("predicted_0"), F.count_if(hit == 1).alias("predicted_1")
    )


def _cells(label: str, prediction: str, where: Column | None) -> dict[str, Column]:
    inside = F.lit(True) if where is None else where
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return {
        "tp": F.count_if(inside & (y == 1) & (p == 1)),
        "fp": F.count_if(inside & (y == 0) & (p == 1)),
        "fn": F.count_if(inside & (y == 1) & (p == 0)),
        "tn": F.count_if(inside & (y == 0) & (p == 0)),
    }


def _ratio(a: Column, b: Column) -> Column:
    """0 when undefined, as metric libraries report it."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(precision * recall * 2, precision + recall)


def class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall and F1 of both classes, weighted values and accuracy, in one pass."""
    counted = df.agg(*[c.alias(n) for n, c in _cells(label, prediction, None).items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n1, n0 = tp + fn, tn + fp
    both = counted.select(
        "tp", "fp", "fn", "tn",
        _ratio(tp, tp + fp).alias("precision_1"),
        _ratio(tp, n1).alias("recall_1"),
        _ratio(tn, tn + fn).alias("precision_0"),
        _ratio(tn, n0).alias("recall_0"),
        _ratio(tp + tn, n1 + n0).alias("accuracy"),
        _ratio(n1, n1 + n0).alias("_share_1"),
    )
    share = F.col("_share_1")

    def weighted(one: Column, zero: Column) -> Column:
        return share * one + (1 - share) * zero

    f1_1 = _f1(F.col("precision_1"), F.col("recall_1"))
    f1_0 = _f1(F.col("precision_0"), F.col("recall_0"))
    return both.withColumns({
        "weighted_precision": weighted(F.col("precision_1"), F.col("precision_0")),
        "weighted_recall": weighted(F.col("recall_1"), F.col("recall_0")),
        "f1_1": f1_1,
        "f1_0": f1_0,
        "weighted_f1": weighted(f1_1, f1_0),
    }).drop("_share_1")


def slice_metrics(
    df: DataFrame, slices: Mapping[str, Column], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Confusion cells, precision and recall inside each named predicate, all in one pass."""
    measured = []
    for name, where in slices.items():
        cells = [c.alias(n) for n, c in _cells(label, prediction, where).items()]
        measured.append(F.struct(F.lit(name).alias("slice"), *cells))
    one_row = df.agg(F.array(*measured).alias("_slices"))
    s = one_row.select(F.explode("_slices").alias("s")).select("s.*")
    return s.withColumns({
        "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
    })


def area_under_roc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve by rank sums, ties counted half; one row.

    Rows collapse to class counts per distinct score, which are range partitioned. Totals per
    block give each block its starting count, so no task sorts more than its own block.
    """
    per_score = df.groupBy(F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    blocks = range_blocks(per_score, ["_score"])
    # One row per block: bounded by the number of shuffle partitions.
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.groupBy("_block").agg(F.sum("_neg").alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    below = Window.partitionBy("_block").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    beaten = F.col("_start") + F.coalesce(F.sum("_neg").over(below), F.lit(0)) + F.col("_neg") / 2
    return (
        blocks.join(F.broadcast(starts), "_block")
        .select("_pos", "_neg", (F.col("_pos") * beaten).alias("_wins"))
        .agg(F.try_divide(F.sum("_wins"), F.sum("_pos") * F.sum("_neg").cast("double")).alias("auc"))
    )


def area_under_roc_by(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """``by`` and ``auc``: exact area under the ROC curve of every group, all groups in one job.

    As :func:`area_under_roc`, with one starting count per group and block; there are at most as
    many as groups and blocks together. A group with one class has a NULL area; NULL keys are a group like others.
    """
    keys = [f"k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)]
    y = F.col(label)
    per_score = df.select(*named, F.col(score).alias("s"), y.alias("y")).groupBy(*keys, "s").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    blocks = range_blocks(per_score, [*keys, "s"])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy(*keys, "_block").agg(F.sum("neg").alias("n"))
    starts = starts.select(*[F.col(k).alias(f"b{k}") for k in keys], F.col("_block").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    below = Window.partitionBy("_block", *keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    same = F.col("_block") == F.col("at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"b{k}"))
    wins = F.col("pos") * (F.col("start") + F.col("below") + F.col("neg") / 2)
    joined = placed.join(starts, same).select(*keys, "pos", "neg", wins.alias("wins"))
    return joined.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, by)]).agg(
        F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg").cast("double")).alias("auc")
    )


def log_loss(df: DataFrame, label: str = "label", probability: str = "score", eps: float = 1e-15) -> DataFrame:
    """Mean negative log-likelihood of the true class, with probabilities kept off 0 and 1."""
    p = F.least(F.greatest(F.col(probability), F.lit(eps)), F.lit(1 - eps))
    return df.agg(
        F.avg(-F.log(F.when(F.col(label) == 1, p).otherwise(1 - p))).alias("log_loss")
    )


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``prediction - label`` per row: -1 missed, 0 right, 1 false alarm."""
    return df.withColumn("residual", F.col(prediction).cast("int") - F.col(label).cast("int"))


def residual_profile(df: DataFrame, features: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean and deviation of each feature per residual class."""
    aggs = [F.count("*").alias("rows")]
    for c in features:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return residuals(df, label, prediction).groupBy("residual").agg(*aggs)


def outcome(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """'hit' for a positive that was predicted, 'missed' for one that was not, 'other' for the rest."""
    positive = F.col(label) == 1
    return df.withColumn(
        "outcome",
        F.when(positive & (F.col(prediction) == 1), "hit").when(positive, "missed").otherwise("other"),
    )


def positive_class(scores: Column) -> Column:
    """Class with the largest score of an array of class scores; the first one on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def evaluate(predictions: DataFrame, metric: str, label: str = "label") -> float:
    """One of MLlib's metrics of a fitted model's output; ranking metrics use the probability."""
    if metric in ("areaUnderROC", "areaUnderPR"):
        return BinaryClassificationEvaluator(
            labelCol=label, rawPredictionCol="probability", metricName=metric, numBins=0
        ).evaluate(predictions)
    names = {"precision": "precisionByLabel", "recall": "recallByLabel"}
    evaluator = MulticlassClassificationEvaluator(
        labelCol=label, predictionCol="prediction", metricName=names.get(metric, metric)
    )
    if metric in names:
        evaluator = evaluator.setMetricLabel(1.0)
    return evaluator.evaluate(predictions)
