"""Checks a user runs on a table: counts, nulls, levels, summary figures, key coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.cohort import group_percentile
from cohortlens.operators.scale import materialise


def row_count(df: DataFrame, condition: Column | None = None) -> DataFrame:
    """Number of rows, or of rows meeting a condition, as a one-row table."""
    return df.agg((F.count("*") if condition is None else F.count_if(condition)).alias("rows"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column, one row."""
    return df.agg(*[F.count_if(F.isnull(c)).alias(c) for c in columns or df.columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per level, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def positive_rate(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Share of positive rows per group."""
    return df.groupBy(*by).agg(F.avg(label).alias("positive_rate"))


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Positives, negatives and their ratio."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.try_divide(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).alias("ratio"),
    )


def distinct_count(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """Number of distinct values: two-step exact count, or a sketch."""
    counted = F.approx_count_distinct(column) if approx else F.count_distinct(column)
    return df.agg(counted.alias("distinct_values"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, stddev, min, quartiles and max, one row per column.

    Columns are unpivoted and written once, so all of them are summarised by the same two
    aggregations and the input is evaluated once.
    """
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    tall = materialise(numeric.unpivot([], list(columns), "column", "value"), "tall")
    figures = tall.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = group_percentile(tall, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return figures.join(F.broadcast(quartiles), "column", "left")  # one row per column: bounded


def key_coverage(df: DataFrame, key: str, reference: DataFrame, reference_key: str) -> DataFrame:
    """How many distinct keys there are and how many of them the reference table knows."""
    keys = df.select(F.col(key).alias("_key")).distinct()
    known = reference.select(F.col(reference_key).alias("_key")).distinct()
    return (
        keys.join(known.withColumn("_known", F.lit(1)), "_key", "left")
        .agg(F.count("*").alias("keys"), F.count("_known").alias("known_keys"))
    )


def known_rows(df: DataFrame, key: str, reference: DataFrame, reference_key: str, known: bool = True) -> DataFrame:
    """Rows whose key the reference table knows (or does not know)."""
    ids = reference.select(F.col(reference_key).alias(key)).distinct()
    return df.join(ids, key, "left_semi" if known else "left_anti")
