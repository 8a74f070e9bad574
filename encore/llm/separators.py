"""Token counts of documents in flat token files that have no index.

A flat file is token ids in a row, an end-of-document id behind each document. Blocks of files are searched for that id
independently; a document that crosses blocks is stitched by a prefix scan over the blocks' counts and last separators.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .frames import LONG, TEXT, column, field, map_batches, open_store, remove, shared_folder, written
from .tokens import default_path, encoder

END = 50256
BLOCK_TOKENS = 1 << 20
#: Blocks that are scanned one after another; their sums are scanned again.
RUN = 1024
_TEXTS = 512


def write_flat(documents: DataFrame, id_col: str, text_col: str, folder: str, path: str, end: int = END, width: int = 2) -> DataFrame:
    """Writes token files of ``width`` bytes an id, one per task, and returns (file, ordinal, id) of what they hold.

    A file's name is new for every attempt of a task, and only files of attempts that succeeded are in the result, so
    a lost executor leaves nothing that is counted twice.
    """
    source = documents.select(column(id_col), column(text_col).cast("string"))
    schema = T.StructType([field("file", TEXT), field("ordinal", LONG), T.StructField(id_col, documents.schema[id_col].dataType)])
    kind, last = f"<u{width}", np.array([end], f"<u{width}").tobytes()

    def run(batches):
        encode, (store, root) = encoder(path, literal=True), open_store(folder)
        store.create_dir(root, recursive=True)
        name, done = f"{root}/{uuid.uuid4().hex}.tokens", 0
        with store.open_output_stream(name) as out:
            for whole in batches:
                for low in range(0, whole.num_rows, _TEXTS):
                    batch = whole.slice(low, _TEXTS)
                    for ids in encode(batch.column(1).to_pylist()):
                        out.write(np.frombuffer(ids, "<u4").astype(kind).tobytes() + last)
                    n = batch.num_rows
                    yield [pa.array([name.rpartition("/")[2]] * n, pa.string()), pa.array(np.arange(done, done + n)), batch.column(0)]
                    done += n

    return map_batches(source, schema, run)


def _blocks(spark: SparkSession, folder: str, files: list[str], width: int, block: int) -> DataFrame:
    """(file, block, first token, tokens) for every block of every file."""
    store, root = open_store(folder)
    sizes = [(f, store.get_file_info(f"{root}/{f}").size // width) for f in files]
    schema = T.StructType([field("file", TEXT), field("tokens", LONG)])
    frame = spark.createDataFrame(sizes, schema).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((tokens - 1) div {block} as int)"))))
    )
    blocks = max(1, sum(max(1, -(-n // block)) for _, n in sizes))
    return frame.repartition(min(blocks, 4096), "file", "block")


def separators(spark: SparkSession, folder: str, files: list[str], end: int = END, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, tokens, block, positions): where the end id stands in each block."""
    schema = T.StructType([field("file", TEXT), field("tokens", LONG), field("block", LONG), field("positions", T.ArrayType(LONG))])

    def run(batches):
        store, root = open_store(folder)
        for batch in batches:
            found = []
            for name, number in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    raw = source.read_at(block * width, number * block * width)
                ids = np.frombuffer(raw, f"<u{width}", count=len(raw) // width)
                found.append((np.flatnonzero(ids == end) + number * block).tolist())
            yield [batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int64()))]

    return map_batches(_blocks(spark, folder, files, width, block).select("file", "tokens", "block"), schema, run)


def document_counts(found: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document, from the separators of the blocks.

    The prefix scan has two levels: within runs of blocks, and over the sums of the runs, so a file of any length is
    scanned in parts. Tokens behind the last separator of a file are a document that is not closed.
    """
    summary = found.select(
        "file", "tokens", "block", F.expr(f"block div {RUN}").alias("run"), F.size("positions").cast("long").alias("n"), F.expr("array_max(positions)").alias("last")
    )
    runs = summary.groupBy("file", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select(
        "file", "run", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("run_before"), F.max("last").over(over).alias("run_last")
    )
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("run", F.expr(f"block div {RUN}")).select(
        "file", "run", "positions",
        F.coalesce(F.sum(F.size("positions").cast("long")).over(inside), F.lit(0)).alias("before"),
        F.max(F.expr("array_max(positions)")).over(inside).alias("last_before"),
    ).join(carried, ["file", "run"])
    opened = F.coalesce(F.greatest("last_before", "run_last"), F.lit(-1))
    closed = placed.select(
        "file", (F.col("before") + F.col("run_before")).alias("before"), opened.alias("opened"), "positions", F.posexplode("positions").alias("k", "position")
    ).select(
        "file", (F.col("before") + F.col("k")).alias("ordinal"),
        (F.when(F.col("k") == 0, F.col("opened")).otherwise(F.expr("try_element_at(positions, k)")) + 1).alias("start"),
        "position",
    )
    tail = summary.groupBy("file", "tokens").agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(
        F.col("tokens") > F.coalesce(F.col("last"), F.lit(-1)) + 1
    )
    return closed.select("file", "ordinal", "start", (F.col("position") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed")).unionByName(
        tail.select(
            "file", F.col("n").alias("ordinal"), (F.coalesce(F.col("last"), F.lit(-1)) + 1).alias("start"),
            (F.col("tokens") - F.coalesce(F.col("last"), F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("closed"),
        )
    )


def token_counts(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END,
    width: int = 2, block: int = BLOCK_TOKENS,
) -> DataFrame:
    """Flat token files of all documents, and from the files alone the token count of every document.

    The end id must not occur in a text: it is the vocabulary's special token, which ordinary text never yields. Null and
    empty texts have no tokens. Repeated rows are counted each. Other columns are not read. An empty table gives an
    empty result. The files are removed once they have been searched.
    """
    spark, folder = documents.sparkSession, shared_folder(documents.sparkSession, "tokens")
    held = written(write_flat(documents, id_col, text_col, folder, path or default_path(), end, width), "token-files")
    files = [row["file"] for row in held.select("file").distinct().collect()]
    if not files:
        return held.select(column(id_col), F.lit(0).cast("long").alias("n_tokens"), "file", "ordinal", F.lit(0).cast("long").alias("start"))
    found = written(separators(spark, folder, files, end, width, block), "separators")
    remove(spark, folder)
    counts = document_counts(found)
    return held.join(counts, ["file", "ordinal"]).select(column(id_col), "n_tokens", "file", "ordinal", "start")
