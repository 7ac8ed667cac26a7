"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes as written, that may be sent to every task.
BROADCAST_BYTES = 32 << 20
#: Rows that go to a Python worker at once; texts are long, so the usual 10,000 take much memory.
BATCH_ROWS = 1000
_LOCAL_FOLDERS: dict[str, str] = {}
_HELD: dict[str, Callable[[], object]] = {}


def hold_memory(owner: str, release: Callable[[], object] | None = None) -> None:
    """Note in a Python worker that it works for ``owner`` now; what it remembers for others goes.

    Workers are used again by later stages, so tables of one operator would stay beside those of
    the next.
    """
    for other in [o for o in _HELD if o != owner]:
        _HELD.pop(other)()
    if release is not None:
        _HELD[owner] = release


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and keep batches small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without it gets one that leaves its settings alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="llm-")
    return _LOCAL_FOLDERS[application]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        free.append(name)
    return free


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and every later read sees the
    same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table made by :func:`stored`."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    total = 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def small_or_not(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table with a broadcast hint if its files are small; else as it is (shuffle join)."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def id_remainder(column: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(divisor)


def tokenizer_bytes(name: str) -> bytes:
    """A public vocabulary file; the driver reads it and ships it, so executors need no path."""
    return Path(public_tokenizers.path(name)).read_bytes()


def with_columns_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a missing one is null, so narrower tables work too."""
    return docs.select(*[F.col(f"`{n}`") if n in docs.columns else F.lit(None).cast("string").alias(n) for n in names])
