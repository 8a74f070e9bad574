"""Plumbing between DataFrames and Arrow functions, and tables and files in the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The JVM and the Python worker of a task each hold a few batches at once.
BATCH_BYTES = 8 << 20


def column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def small_batches(spark: SparkSession) -> None:
    """Long texts must not meet in one Arrow batch: bounds a batch by bytes, unless the user has done so."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)) or 0) >= 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def returned_memory():
    """After a task its Python worker waits for the next one beside the JVM: what the task has freed goes back to the system."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, schema: T.StructType, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list]]) -> DataFrame:
    """``mapInArrow`` for functions that yield lists of arrays in the order of ``schema``."""
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with returned_memory():
            for arrays in run(batches):
                yield pa.RecordBatch.from_arrays(
                    [a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, arrow, strict=True)],
                    schema=arrow,
                )
                arrays = None

    return df.mapInArrow(work, schema)


def map_texts(
    df: DataFrame,
    keep: list[str],
    text_col: str,
    fields: list[T.StructField],
    start: Callable[[], Callable[[pa.Array], list]],
) -> DataFrame:
    """The kept columns and, computed from the text, new ones. ``start`` is called once a task, what it returns once a batch."""
    source = df.select(*[column(c).alias(f"k{i}") for i, c in enumerate(keep)], column(text_col).cast("string").alias("t"))
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + fields)

    def run(batches):
        work = start()
        for batch in batches:
            yield [*(batch.column(i) for i in range(len(keep))), *work(batch.column(len(keep)))]

    return map_batches(source, schema, run)


def keep_rows(df: DataFrame, text_col: str, start: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """The rows whose text passes, with all their columns as they were."""
    small_batches(df.sparkSession)
    place = df.columns.index(text_col)

    def work(batches):
        with returned_memory():
            decide = start()
            for batch in batches:
                yield batch.filter(pa.array(decide(batch.column(place)), pa.bool_()))

    return df.mapInArrow(work, df.schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables and files that all executors and the driver read.

    ``spark.checkpoint.dir`` names the place; where it is unset, the warehouse serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if "://" not in base:
        base = f"file://{base.removeprefix('file:')}" if base.startswith(("/", "file:")) else base
    return f"{base.rstrip('/')}/encore-llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The frame as Parquet in the shared folder: computed once, lineage cut, safe from lost executors."""
    path = folder or shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that an operator made with ``shared_folder`` and no longer needs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_store(uri: str):
    """Arrow file system and path behind a folder's URI, for byte-level files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


LONG, DOUBLE, BOOL, TEXT, BINARY, INT = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.BinaryType(), T.IntegerType()
