"""Readers and writers of files and tables."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CORRUPT = "_corrupt_record"
FILE_PERIOD = r"_(\d{4})_(\d{1,2})\.[A-Za-z.]+$"


# --- reading ----------------------------------------------------------------------------------------------------


CSV_OPTIONS = {"quote": '"', "escape": '"'}


def _csv(spark: SparkSession):
    return spark.read.option("header", True).options(**CSV_OPTIONS)


def _header(spark: SparkSession, path: str) -> str:
    """First line of one file."""
    first = spark.read.text(path).first()
    return first["value"] if first else ""


def _headers(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """First lines of all files, read side by side; each job stops at its first row."""
    if not paths:
        return []
    with ThreadPoolExecutor(max_workers=min(16, len(paths))) as pool:
        return list(pool.map(lambda path: _header(spark, path), paths))


def read_drifting_csv(
    spark: SparkSession,
    paths: Sequence[str],
    keep_corrupt: bool = False,
    columns: Sequence[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV files whose columns come and go, united by name, all as text, with the file name in ``archivo``.

    Records with the wrong number of fields are dropped, or kept with their text in ``_corrupt_record`` if
    ``keep_corrupt`` is set, so that drops can be counted. Files that share a header are read together. All columns
    are parsed whatever a query uses, so the same records count as malformed. Quoted fields may hold line breaks, for
    which each file is read by one task; files without them can be split with ``multi_line=False``.
    """
    by_header: dict[str, list[str]] = {}
    for path, header in zip(paths, _headers(spark, paths), strict=True):
        by_header.setdefault(header, []).append(path)
    united: DataFrame | None = None
    for header, files in by_header.items():
        names = next(csv.reader([header.lstrip("\ufeff")]), [])
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
        part = (
            _csv(spark)
            .options(multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False, enforceSchema=True)
            .schema(schema)
            .csv(files)
            .withColumn("archivo", F.col("_metadata.file_name"))
        )
        # Spark refuses queries over the corrupt text alone, such as a count of it; a null of the first column goes with it.
        first = F.col(f"`{names[0]}`") if names else F.lit(None)
        part = part.withColumn(CORRUPT, F.coalesce(CORRUPT, F.nullif(first, first)))
        wanted = [F.col(f"`{n}`") for n in (*names, CORRUPT) if n == CORRUPT or columns is None or n in columns]
        part = part.select(*wanted, "archivo")
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
    if united is None:
        raise ValueError("no files given")
    return united if keep_corrupt else united.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def with_file_period(rows: DataFrame, file_name: str = "archivo") -> DataFrame:
    """Year and month from a file name that ends in ``_YYYY_MM``."""
    part = lambda i: F.regexp_extract(file_name, FILE_PERIOD, i).try_cast("int")
    return rows.withColumns({"archivo_anio": part(1), "archivo_mes": part(2)})


def read_monthly_exports(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The listed columns of monthly CSV exports with the period of each file."""
    return with_file_period(read_drifting_csv(spark, paths, columns=columns))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_fact(
    spark: SparkSession,
    path: str,
    partition: str,
    start: str | date | None = None,
    end: str | date | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A partitioned fact, limited by its text partition column.

    The bounds are literals, so only the wanted folders are listed and read; without bounds the null partition
    is left out. Facts that are partitioned by month take 'YYYY-MM' bounds. With a
    ``schema`` no folder is listed to infer one.
    """
    schema = schema or spark.read.parquet(path).schema
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType()) if f.name == partition else f for f in schema.fields]
    )
    rows = spark.read.schema(as_text).parquet(path)
    if start is None and end is None:
        return rows.filter(F.col(partition).isNotNull())
    if start is not None:
        rows = rows.filter(F.col(partition) >= str(start))
    if end is not None:
        rows = rows.filter(F.col(partition) <= str(end))
    return rows


def register_view(rows: DataFrame, name: str) -> DataFrame:
    rows.createOrReplaceTempView(name)
    return rows


def read_ids(spark: SparkSession, path: str, column: str = "social_id") -> DataFrame:
    """An id list from a CSV with a header."""
    return _csv(spark).csv(path).select(F.col(column).cast("string").alias("social_id"))


# --- writing ----------------------------------------------------------------------------------------------------


def replace_table(rows: DataFrame, name: str, partition_by: Iterable[str] = ()) -> None:
    """Create the table or replace what it holds."""
    writer = rows.write.mode("overwrite")
    columns = list(partition_by)
    (writer.partitionBy(*columns) if columns else writer).saveAsTable(name)


def write_parquet(rows: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Parquet, optionally partitioned; rows of one partition value are spread over all tasks that hold them."""
    writer = rows.write.mode("overwrite")
    columns = list(partition_by)
    (writer.partitionBy(*columns) if columns else writer).parquet(path)


def write_bucketed(rows: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by its key: later joins and aggregates on the key need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_csv_file(rows: DataFrame, path: str) -> None:
    """One CSV file of exactly this name, as exports for people have it; a single task writes it."""
    spark = rows.sparkSession
    folder = f"{path}-parts"
    write_csv(rows.coalesce(1), folder)
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in system.globStatus(hadoop.Path(f"{folder}/part-*"))]
    system.delete(hadoop.Path(path), True)
    system.rename(part, hadoop.Path(path))
    system.delete(hadoop.Path(folder), True)


def nan_to_null(rows: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes null."""
    floating = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else rows


def write_json_results(results: Mapping[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per result, nulls written out."""
    for name, rows in results.items():
        nan_to_null(rows).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
