"""A corpus through five stages: toxic documents go, then documents that fail the quality rules, then all but one of each group of
near-duplicates, then documents that hold benchmark passages; what stays is packed into training sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from encore.llm import bands, decontam, jaccard, mil, packing
from encore.llm.frames import remove, shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents whose sentences together are toxic go."""
    model = mil.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mil.drop_toxic(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that repeat themselves, hardly compress or have almost no words go."""
    return bands.keep_by_quality(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near-duplicates stays."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with a window of a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Training and packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of a folder.

    Each stage is written, and read again as the next one's input; what the stage before wrote is removed then.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        folder = shared_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if last is not None:
            remove(spark, last)
        docs, last = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
