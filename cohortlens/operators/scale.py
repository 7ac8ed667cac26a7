"""Helpers that keep joins and materialised tables safe on large, skewed inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Group statistics are broadcast only up to this many rows; larger ones are joined with salt.
BROADCAST_ROWS = 200_000
#: Number of slices a hot group is split into by the salted join.
SALTS = 32
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, visible to every executor.

    Taken from ``spark.checkpoint.dir``. Only a local session without that setting gets a
    folder of its own, which leaves the session's settings as they are.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="cohortlens-")
    return _LOCAL_FOLDERS[application]


def drop_stored_tables(spark: SparkSession) -> bool:
    """Delete every intermediate table of this application; results built on them end with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/cohortlens/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_table_path(spark: SparkSession, label: str = "table") -> str:
    """A fresh path under the shared folder, inside one subfolder per application."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/cohortlens/{application}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage in storage that outlives executors, and later reads keep column pruning,
    filter pushdown and (with ``partition_by``) partition pruning.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    if partition_by:
        balanced(df, partition_by).write.partitionBy(*partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


def balanced(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of one partition value brought together for writing, crowded values split.

    Adaptive execution sizes the pieces: few files per value, and no task gets a whole hot value.
    """
    return df.hint("rebalance", *by)


def join_group_stats(
    left: DataFrame,
    stats: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_broadcast_rows: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Attach one row of statistics per group to every row of ``left``.

    ``stats`` is written first and counted: a small table is broadcast, so ``left`` is not
    shuffled and a hot group stays spread over all tasks. A larger table goes through a join
    on (group, salt), which cuts each hot group into ``SALTS`` slices. ``stored`` says that
    ``stats`` is a written table already.
    """
    on = list(on)
    if not stored:
        stats = materialise(stats, "stats")
    limit = BROADCAST_ROWS if max_broadcast_rows is None else max_broadcast_rows
    if stats.count() <= limit:
        return left.join(F.broadcast(stats), on, how)
    return salted_join(left, stats, on, how)


def broadcast_if_small(table: DataFrame, max_rows: int | None = None) -> DataFrame:
    """A stored table with a broadcast hint up to ``BROADCAST_ROWS`` rows; else joined by shuffle."""
    limit = BROADCAST_ROWS if max_rows is None else max_rows
    return F.broadcast(table) if table.count() <= limit else table


def salted_join(
    left: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join on (group, salt) with ``stats`` repeated per salt.

    The salt is the row's number within its partition, so equal rows of a hot group are spread
    too; which row gets which salt does not change the result.
    """
    salted = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    repeated = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def range_blocks(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Cut ``df`` into evenly filled blocks that follow ``order``.

    Adds ``_block``; all rows of block i sort before those of block i + 1. Boundaries come from
    Spark's own range partitioning, so they adapt to the data; the result is written once so
    that every later use sees the same blocks.
    """
    cols = [F.col(c) for c in order]
    spread = df.repartitionByRange(blocks, *cols) if blocks else df.repartitionByRange(*cols)
    return materialise(spread.withColumn("_block", F.spark_partition_id()), "blocks")


def blocks_in_order(df: DataFrame, order: Sequence[str]) -> Iterator[pa.Table]:
    """All rows of ``df`` in ``order`` on the driver, one range block after another; empty blocks are left out."""
    blocks = range_blocks(df, order)
    for r in blocks.select("_block").distinct().orderBy("_block").collect():
        yield blocks.where(F.col("_block") == r["_block"]).drop("_block").coalesce(1).sortWithinPartitions(*order).toArrow()
