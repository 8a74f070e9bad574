"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import remove, shared_folder, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours on the smallest one: larger neighbours in a large star, smaller ones in a small star."""
    if large:
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    joined = links.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in the links (a, b): the smallest id that links reach.

    Every round is written to the shared folder, and the one before it removed. The number of rounds grows with the
    logarithm of the longest chain. No task sees more of a hub than a join deals to it.
    """
    spark = links.sparkSession
    folder = shared_folder(spark, name)
    now = written(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), name, f"{folder}/0")
    mark = None
    for step in range(1, 1000):
        new = _star(_star(now, True), False)
        new = written(new, name, f"{folder}/{step}")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, f"{folder}/{step - 1}")
        now = new
        if state == mark:
            break
        mark = state
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
