"""Reading count and attribute tables (CSV, JSON arrays, Parquet) and link lists; writing results."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import typed
from cohortlens.operators.scale import balanced
from cohortlens.sources.schemas import ATTRIBUTE_SCHEMA, COUNT_SCHEMA

# Fixed value: state and year inside the names of downloaded count files.
COUNT_FILE_PATTERN = r"census_(\d+)_(\d+)"


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | str | None = None,
    infer: bool = False,
) -> DataFrame:
    """CSV files with a header, by path, list or glob.

    A declared ``schema`` names the columns wanted and their types; they are found by the names
    in the header of the first file, in whatever order, and every other file must have the same
    header, else reading it raises. ``infer`` samples types with one more pass; with neither
    every column is a string.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        return (reader.option("inferSchema", True) if infer else reader).csv(paths)
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return _csv_with_header(spark, paths, wanted, reader.csv(paths).columns)


def _csv_with_header(spark: SparkSession, paths: str | Sequence[str], wanted: T.StructType, header: Sequence[str]) -> DataFrame:
    absent = [f.name for f in wanted if f.name not in header]
    if absent:
        raise ValueError(f"columns {absent} are not in the header {list(header)}")
    types = {f.name: f.dataType for f in wanted}
    by_header = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.schema(by_header).csv(paths).select(*wanted.names)


def csv_headers(spark: SparkSession, paths: Sequence[str], parallelism: int = 16) -> dict[tuple[str, ...], list[str]]:
    """Files under the paths (folders, globs) by the columns in their first line; empty files are left out.

    Spark lists the files; of each only the start is read, through Hadoop's file systems and
    codecs, several at a time.
    """
    files = sorted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).inputFiles())
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()

    def header(name: str) -> tuple[str, ...]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
            plain = codec.createInputStream(stream) if codec is not None else stream
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
        finally:
            stream.close()
        return tuple(next(csv.reader([line.removeprefix("\ufeff")]))) if line else ()

    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(parallelism) as pool:
        for name, columns in zip(files, pool.map(header, files)):
            if columns:
                found.setdefault(columns, []).append(name)
    return found


def read_csv_files(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Files (or folders or globs) whose headers list the columns in any orders, found by name.

    Files are grouped by header and each group is one scan, however many files it has. A header
    without a wanted column raises; paths without files give an empty table.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    groups = csv_headers(spark, paths)
    if not groups:
        return spark.createDataFrame([], wanted)
    return combine([_csv_with_header(spark, files, wanted, header) for header, files in groups.items()])


def read_counts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Count tables of any number of states and years, columns found by name."""
    return read_csv(spark, paths, COUNT_SCHEMA)


def read_attributes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Attribute tables: text as stored, to be typed afterwards."""
    return read_csv(spark, paths, ATTRIBUTE_SCHEMA)


def parse_json_tables(documents: DataFrame, column: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of JSON tables: arrays of arrays whose first entry is the header.

    Fields are found by their position in each document's own header, so documents may order
    their columns differently. Every field is text; ``keep`` carries columns of the document.
    A document that is no such array raises; NULL and blank documents have no rows.
    """
    text = F.when(F.trim(F.col(column)) != "", F.col(column))
    table = F.from_json(text, "array<array<string>>", {"mode": "FAILFAST"})
    parsed = documents.select(*keep, table.alias("_t")).withColumn("_header", F.get("_t", F.lit(0)))
    rows = parsed.select(
        *keep, "_header", F.explode(F.slice("_t", F.lit(2), F.greatest(F.size("_t"), F.lit(1)))).alias("_row")
    )

    def field(name: str) -> Column:
        return F.get("_row", (F.array_position("_header", name) - 1).cast("int")).alias(name)

    return rows.select(*keep, *[field(n) for n in names])


def read_json_tables(
    spark: SparkSession, paths: str | Sequence[str], names: Sequence[str], one_per_file: bool = True
) -> DataFrame:
    """JSON tables from files, one per file, or one per line for packed files (splittable)."""
    docs = spark.read.text(paths, wholetext=one_per_file)
    return parse_json_tables(docs, "value", names)


def read_json_rows(spark: SparkSession, paths: str | Sequence[str], header: Sequence[str]) -> DataFrame:
    """JSON tables with one inner array per line, all with the same known header.

    Lines are parsed on their own, so a large file is split over many tasks. Blank lines and the
    outer brackets are skipped; any other line that is no array raises.
    """
    line = F.regexp_extract("value", r"^\s*\[?(\[.*?\])\]?,?\s*$", 1)
    row = F.from_json(F.nullif(line, F.lit("")), "array<string>", {"mode": "FAILFAST"})
    names = F.array(*[F.lit(h) for h in header])
    wrong = F.raise_error(F.concat(F.lit("no JSON row: "), F.col("value"))).cast("boolean")
    known = F.when(F.col("_row").isNotNull(), ~F.col("_row").eqNullSafe(names)).otherwise(
        F.when(F.col("value").rlike(r"^\s*[\[\]]?\s*,?\s*$"), F.lit(False)).otherwise(wrong)
    )
    parsed = spark.read.text(paths).select("value", row.alias("_row")).filter(known)
    return parsed.select(*[F.get("_row", F.lit(i)).alias(h) for i, h in enumerate(header)])


def typed_by(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns cast to a schema; text that does not parse becomes NULL."""
    return df.select(*[typed(f.name, f.dataType.simpleString()).alias(f.name) for f in schema])


def stamp(df: DataFrame, **values) -> DataFrame:
    """Constant attributes added to every row."""
    return df.withColumns({name: F.lit(v) for name, v in values.items()})


def stamp_from_path(df: DataFrame, pattern: str = COUNT_FILE_PATTERN) -> DataFrame:
    """State (text) and year (int) read from each row's file name; NULL if it has none."""
    path = F.col("_metadata.file_path")
    return df.withColumns({
        "state": F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")),
        "year": typed(F.regexp_extract(path, pattern, 2), "int"),
    })


def combine(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables of several files appended by column name."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def anchors(pages: DataFrame, id: str, html: str, first: int | None = None, length: int | None = None) -> DataFrame:
    """Texts of the links of each page, in order, with their position.

    Tags inside a link are taken out of its text. ``first`` and ``length`` take a positional
    slice of the list, counted from 1.
    """
    inner = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1))
    texts = F.transform(inner, lambda t: F.regexp_replace(t, "(?s)<[^>]*>", ""))
    if first is not None:
        texts = F.slice(texts, F.lit(first), F.lit(length))
    return pages.select(id, F.posexplode(texts).alias("pos", "text")).select(
        id, (F.col("pos") + 1).alias("pos"), "text"
    )


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_file: int | None = None) -> None:
    """CSV with header, written in parallel, one folder per partition value.

    Rows are brought together per value and crowded values are split over several tasks;
    ``rows_per_file`` splits files further.
    """
    writer = (balanced(df, partition_by) if partition_by else df).write.mode("overwrite").option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, optionally laid out by partition columns."""
    writer = (balanced(df, partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
