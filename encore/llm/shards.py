"""Shards of near-equal size by longest-processing-time scheduling.

Equal texts stay together. Groups are served by falling size, each to the shard that is least loaded then, through a
heap. Groups of one size are alike to the schedule, so it runs over size classes: how many groups of a class every
shard gets is exact, and which ones is settled by their rank in the class. Sizes keep twelve significant bits in their
class, so there are at most a few thousand classes a doubling of size, however many documents there are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F, types as T

from .frames import LONG, column, field, written

SHARDS = 16
BITS = 12
#: Rows that one task ranks.
LANE_ROWS = 100_000


def schedule(classes: list[tuple[float, int]], shards: int) -> list[list[int]]:
    """For classes of (size, count) by falling size: how many groups of each every shard gets.

    The same as giving one group after the other to the least loaded shard, the lower number first among equals. Most
    groups of a large class are dealt at once: all that would go to a shard before any load passes a common level.
    """
    load = [0.0] * shards
    out = []
    for size, count in classes:
        given = [0] * shards
        if count > 4 * shards:
            low, high = min(load), max(load) + size * count
            for _ in range(100):
                level = (low + high) / 2
                if sum(max(0, int((level - x) // size)) for x in load) <= count:
                    low = level
                else:
                    high = level
            given = [max(0, int((low - x) // size)) for x in load]
        heap = [(x + n * size, i) for i, (x, n) in enumerate(zip(load, given, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(given)):
            x, i = heap[0]
            given[i] += 1
            heapq.heapreplace(heap, (x + size, i))
        for x, i in heap:
            load[i] = x
        out.append(given)
    return out


def _class(size: str) -> F.Column:
    """The size with all but its leading bits cleared."""
    cut = f"greatest(0, length(bin({size})) - {BITS})"
    return F.expr(f"shiftleft(shiftright({size}, {cut}), {cut})")


def _rank(frame: DataFrame, keys: list[str], order: list[str], spread: str, rows: int, name: str) -> DataFrame:
    """Gapless number from 0 within the keys; no task orders more than a lane of rows, even if all share one key."""
    lanes = max(1, -(-rows // LANE_ROWS))
    dealt = frame.withColumn("lane", F.pmod(F.xxhash64(spread), F.lit(lanes)))
    before = Window.partitionBy(*keys).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "lane").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(*keys, "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*keys, "lane").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(starts, [*keys, "lane"]).withColumn(name, F.col("before") + F.col("within")).drop("lane", "before", "within")


def assign_shards(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """The id, size, text checksum, shard and place in the shard of every document.

    Size is the UTF-8 bytes of the text plus one; null counts as an empty text. Documents with equal texts share a
    shard. Repeated rows have places of their own, null ids come first. Other columns are not read. An empty table
    gives an empty result.

    What reaches the driver is one row per size class. A group with a large share of all rows is one row before any
    join, and its rows meet their shard in a join that adaptive execution can split.
    """
    spark = documents.sparkSession
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    sized = written(
        documents.select(
            column(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)).alias("digest"),
        ),
        "sized",
    )
    groups = written(
        sized.groupBy("digest").agg((F.sum("size")).alias("bytes")).withColumn("class", _class("bytes")), "shard-groups"
    )
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    classes.sort(key=lambda row: -row["class"])
    plan = schedule([(row["bytes"] / row["n"], row["n"]) for row in classes], shards)
    rows = []
    for row, given in zip(classes, plan, strict=True):
        ends, at = [], 0
        for n in given[:-1]:
            at += n
            ends.append(at)
        rows.append((row["class"], ends))
    ends = spark.createDataFrame(rows, T.StructType([field("class", LONG), field("ends", T.ArrayType(LONG))]))
    ranked = _rank(groups, ["class"], ["digest"], "digest", groups.count(), "rank")
    placed = ranked.join(F.broadcast(ends), "class").select(
        "digest", F.expr("cast(size(filter(ends, e -> e <= rank)) as int)").alias("shard")
    )
    sharded = sized.join(placed, "digest").drop("digest")
    return _rank(sharded, ["shard"], ["id", "row"], "row", sized.count(), "slot").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot"
    )


def shard_loads(assigned: DataFrame) -> DataFrame:
    """Rows and bytes of every shard."""
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
