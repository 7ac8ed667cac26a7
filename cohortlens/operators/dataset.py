"""Train and test sets: cleaning, splitting, balancing, assembling and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any NULL in the given (or all) columns."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def positive_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose listed columns are all above 0; drops zero, negative sentinels and NULL."""
    for c in columns:
        df = df.filter(F.col(c) > 0)
    return df


def hash_fraction(keys: Sequence[str], seed: int | str) -> Column:
    """A reproducible number in [0, 1) per key: leading 32 bits of the MD5 of key and seed.

    Splitting, sampling and folding use different seeds, so they are independent of each other.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def hash_split(
    df: DataFrame, keys: Sequence[str], train: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: stable under retries, repartitioning and growth."""
    u = hash_fraction(keys, seed)
    return df.filter(u < train), df.filter(u >= train)


def random_split(df: DataFrame, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Spark's own random split; depends on row order and partitioning."""
    return tuple(df.randomSplit([train, 1 - train], seed=seed))


def undersample(
    df: DataFrame, label: str, keys: Sequence[str], seed: int = 42
) -> DataFrame:
    """All rows of the rarer class and a hash sample of the other of about the same size.

    The share kept of each class is a scalar subquery, so the result stays lazy.
    """
    ones, zeros = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    draw = hash_fraction(keys, f"sample-{seed}")
    share = {
        value: df.agg(F.least(F.try_divide(other, own), F.lit(1.0)).alias("share")).scalar()
        for value, own, other in ((1, ones, zeros), (0, zeros, ones))
    }
    return df.filter(
        ((F.col(label) == 1) & (draw < share[1])) | ((F.col(label) == 0) & (draw < share[0]))
    )


def undersample_random(df: DataFrame, label: str, ratio: float, seed: int = 42) -> DataFrame:
    """Spark's stratified sample; ``ratio`` is positives to negatives, above 1 thins the positives."""
    fractions = {1: min(1 / ratio, 1.0) if ratio > 0 else 1.0, 0: min(ratio, 1.0)}
    return df.sampleBy(label, fractions=fractions, seed=seed)


def fold_column(df: DataFrame, keys: Sequence[str], folds: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold number 0..folds-1 from a hash of the key."""
    return df.withColumn(name, F.floor(hash_fraction(keys, f"fold-{seed}") * folds).cast("int"))


def assembler(features: Sequence[str], output: str = "features") -> VectorAssembler:
    """Feature vector; rows with a missing feature are skipped."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="skip")


def min_max_scaler(input: str = "features", output: str = "scaled") -> MinMaxScaler:
    """Scaling of every feature to [0, 1] over the rows it is fitted on."""
    return MinMaxScaler(inputCol=input, outputCol=output)


def standard_scaler(input: str = "features", output: str = "scaled") -> StandardScaler:
    """Centring and division by the sample deviation of the rows it is fitted on."""
    return StandardScaler(inputCol=input, outputCol=output, withMean=True, withStd=True)


def fit_scaling(train: DataFrame, features: Sequence[str], kind: str = "standard"):
    """Assembler and scaler fitted on the training rows only."""
    scaler = {"standard": standard_scaler, "minmax": min_max_scaler}[kind]()
    return Pipeline(stages=[assembler(features), scaler]).fit(train)


def unpack_vector(df: DataFrame, vector: str, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Vector entries as named double columns."""
    entries = vector_to_array(F.col(vector))
    return df.select(*keep, *[entries[i].alias(n) for i, n in enumerate(names)])
