"""Exact ranks, samples and quantiles without sorting everything in one task.

Rows are first counted by a bucket that grows with the sort key. The small table of bucket counts gives each
bucket its starting rank; only the rows of one bucket are ever ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .aggregates import as_col

HASH_DIGITS = 4


def seeded_hash(key: str | Column, seed: int) -> Column:
    """A repeatable uniform text hash of a key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_col(key).cast("string")).cast("binary"))


def _offsets(counts: DataFrame, bucket: str, size: str) -> DataFrame:
    """Rank of the row before each bucket; ``counts`` has one row per bucket, so its size is bounded by them."""
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0)))


def global_row_number(df: DataFrame, order: Sequence[str], bucket: Column, name: str) -> DataFrame:
    """Row number over the whole table.

    ``bucket`` must not decrease along ``order`` and should spread the rows; it must take few values. The rows are dealt by bucket
    for the order anyway, so their starts meet them there and do not pass through the driver.
    """
    keyed = df.withColumn("_bucket", bucket)
    starts = _offsets(keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), "_bucket", "_n")
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        keyed.join(starts.select("_bucket", "_before").hint("shuffle_hash"), "_bucket")
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_bucket", "_before")
    )


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42, digits: int = HASH_DIGITS) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), chosen by a seeded hash of a unique key; the same rows every time.

    Rows are cut by hash prefix; only the prefix on which the n-th row falls is sorted.
    """
    hashed = df.withColumn("_hash", seeded_hash(key, seed)).withColumn("_bucket", F.substring("_hash", 1, digits))
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = _offsets(counts, "_bucket", "_n").filter(F.col("_before") < n)
    kept = hashed.join(F.broadcast(starts), "_bucket")
    whole = kept.filter(F.col("_before") + F.col("_n") <= n)
    edge = kept.filter(F.col("_before") + F.col("_n") > n).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", as_col(key)))
    )
    return (
        whole.select(*df.columns)
        .unionByName(edge.filter(F.col("_before") + F.col("_rank") <= n).select(*df.columns))
    )


def magnitude_bucket(value: Column) -> Column:
    """A whole number that never decreases with the value and takes some tens of thousands of values."""
    scaled = F.floor(F.log1p(F.abs(value)) * 1000)
    return F.when(value < 0, -scaled).otherwise(scaled)


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles: one row per group and probability (columns ``by``, ``probability``, ``value``).

    Equal values are collapsed first, so a value that fills a third of the rows is one row here. NaN counts as missing.
    """
    by = list(by)
    counts = (
        df.select(*by, F.col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", magnitude_bucket(F.col("_v")))
    )
    sizes = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_size"))
    ordered = Window.partitionBy(*by).orderBy("_bucket") if by else Window.orderBy("_bucket")
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumns(
        {
            "_before": F.coalesce(F.sum("_size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_total": F.sum("_size").over(group),
        }
    )
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    places = sizes.withColumn("probability", wanted).withColumn(
        "_at", F.col("probability") * (F.col("_total") - 1)
    )
    # Zero-based positions of the two values each quantile lies between.
    ends = places.withColumn(
        "_pos", F.explode(F.array_distinct(F.array(F.floor("_at").cast("long"), F.ceil("_at").cast("long"))))
    ).filter((F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_before") + F.col("_size")))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v")
    cumulated = counts.join(
        ends.select(*by, "_bucket").distinct(), [*by, "_bucket"], "left_semi"
    ).withColumn("_through", F.sum("_n").over(inside))
    found = (
        cumulated.join(ends.select(*by, "_bucket", "_before", "probability", "_at", "_pos"), [*by, "_bucket"])
        .filter(F.col("_before") + F.col("_through") > F.col("_pos"))
        .groupBy(*by, "probability", "_at", "_pos")
        .agg(F.min("_v").alias("_v"))
    )
    low = F.min_by("_v", "_pos")
    high = F.max_by("_v", "_pos")
    return found.groupBy(*by, "probability").agg(
        (low + (high - low) * (F.max("_at") - F.floor(F.max("_at")))).alias("value")
    )
