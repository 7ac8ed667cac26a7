"""Files that keep arriving: a manifest of what was read, and only the partitions that can change.

A store is a folder with three Parquet tables: ``manifest`` (one row per file read, with its size and
time), ``panel`` (by state and year of the file) and derived tables by year. New and changed files
name the (state, year) parts that are read again; each is overwritten as a whole, so a run that
ended half way is simply repeated. The manifest is written last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import typed
from cohortlens.operators.scale import balanced, materialise
from cohortlens.sources.tables import COUNT_FILE_PATTERN, read_csv_files

_MANIFEST = "path string, length long, modified timestamp, state string, year int, run long"
#: Parts (state and year of a file) that one run may read again; far above all states times all years.
MOST_PARTS = 100_000


def list_files(spark: SparkSession, paths: Sequence[str], pattern: str = COUNT_FILE_PATTERN) -> DataFrame:
    """``path``, ``length``, ``modified`` of every file, and ``state`` and ``year`` of its name.

    Contents are not read. Files whose names hold no state and year are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    found = files.select("path", "length", F.col("modificationTime").alias("modified"))
    # An empty file has no rows; it is listed as soon as it is filled.
    return found.where("length > 0").select(
        "path", "length", "modified", F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).alias("state"),
        typed(F.regexp_extract("path", pattern, 2), "int").alias("year"),
    ).where("state is not null and year is not null")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table; files of a write that did not come to an end are not seen by readers."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def read_manifest(spark: SparkSession, store: str) -> DataFrame:
    """The newest entry of every file read so far."""
    if not table_exists(spark, f"{store}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    entries = spark.read.schema(_MANIFEST).parquet(f"{store}/manifest")
    newest = entries.groupBy("path").agg(F.max_by(F.struct("length", "modified", "state", "year", "run"), "run").alias("e"))
    return newest.select("path", "e.*")


def overwrite_parts(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows for and leave all others."""
    balanced(df, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_parts(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table of parts with the columns and types of ``like``; empty if it was never written."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def take_arrivals(
    spark: SparkSession,
    paths: Sequence[str],
    store: str,
    schema,
    panel: Callable[[DataFrame], DataFrame],
    derive: Callable[[DataFrame], DataFrame],
    derived: str,
    horizon: int,
    pattern: str = COUNT_FILE_PATTERN,
) -> list[int]:
    """Bring a store up to date with the files under ``paths``; returns the years derived again.

    * New files, and files whose size or time differ from the manifest, name the parts (state and
      year in the file name) to read again, with all files of those parts.
    * ``panel`` turns rows of files (with columns ``state`` and ``year``) into panel rows row by
      row; those parts of the table ``panel`` are overwritten.
    * ``derive`` turns panel rows of some years into the table ``derived``, whose row of year y may
      depend on panel rows of the years y to y + ``horizon`` only. So a changed year c touches the years
      c - ``horizon`` to c; they are derived from c - ``horizon`` to c + ``horizon`` and overwritten.

    Rows must bear the state and year of their file's name, else nothing is written and an error raised.
    A part whose rows all go is deleted. A file that disappears leaves its rows in place until its
    part is read again. Only changed parts and their file names reach the driver.
    """
    now = materialise(list_files(spark, paths, pattern), "files")
    known = read_manifest(spark, store)
    same = ["path", "length", "modified"]
    changed = materialise(now.join(known.select(*same), same, "left_anti").select("state", "year").distinct(), "changed")
    parts = [(r["state"], r["year"]) for r in changed.orderBy("state", "year").limit(MOST_PARTS + 1).collect()]
    if len(parts) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts changed")
    if not parts:
        return []
    again = now.join(F.broadcast(changed), ["state", "year"], "left_semi")
    files = [r["path"] for r in again.select("path").orderBy("path").collect()]
    rows = panel(read_csv_files(spark, files, schema))
    _replace(rows, f"{store}/panel", ["state", "year"], parts)
    years = sorted({y - back for _, y in parts for back in range(horizon + 1)})
    like = rows.limit(0)
    seen = read_parts(spark, f"{store}/panel", like).where(F.col("year").isin([y + ahead for y in years for ahead in range(horizon + 1)]))
    fresh = derive(seen).where(F.col("year").isin(years))
    _replace(fresh, f"{store}/{derived}", ["year"], [(y,) for y in years])
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    again.withColumn("run", F.lit(run).cast("long")).select("path", "length", "modified", "state", "year", "run").write.mode("append").parquet(f"{store}/manifest")
    return years


def _replace(rows: DataFrame, path: str, by: Sequence[str], parts: Sequence[tuple]) -> None:
    """Overwrite exactly the named parts; one that has no rows any more is emptied."""
    spark = rows.sparkSession
    kept = materialise(rows, "parts")
    filled = {tuple(r) for r in kept.select(*by).distinct().limit(len(parts) + 1).collect()}
    if not filled <= set(parts):
        raise ValueError(f"rows of {sorted(filled - set(parts))} came in files of other names")
    overwrite_parts(kept, path, by)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for part in parts:
        if part not in filled:
            folder = hadoop(path + "".join(f"/{c}={v}" for c, v in zip(by, part)))
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
