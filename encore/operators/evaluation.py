"""Out-of-time evaluation of a score.

Rows are counted per distinct score, split into a grid of score buckets; totals of the buckets carry the running
sums from one bucket to the next, so no task sees all scores. ``score`` must lie in [0, 1], ``label`` is 0 or 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranking import seeded_hash

BUCKETS = 1 << 16
TIE_DIGITS = 3


def _bucket(score: Column) -> Column:
    return F.floor(score * BUCKETS).cast("int")


def score_table(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score, best first in ``puesto``: counts and running counts down to and with it."""
    counts = (
        scored.groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
        .withColumn("_b", _bucket(F.col("score")))
    )
    # One row per bucket, so this window and the broadcast of its result are bounded by the grid.
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"pos": F.sum("pos"), "neg": F.sum("neg"), "rows": F.count(F.lit(1))}
    starts = counts.groupBy("_b").agg(*[c.alias(f"_{n}") for n, c in sums.items()]).select(
        "_b", *[F.coalesce(F.sum(f"_{n}").over(above), F.lit(0)).alias(f"_{n}_before") for n in sums]
    )
    inside = Window.partitionBy("_b").orderBy(F.desc("score")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return counts.join(F.broadcast(starts), "_b").select(
        "score",
        "pos",
        "neg",
        (F.col("_pos_before") + F.sum("pos").over(inside)).alias("cum_pos"),
        (F.col("_neg_before") + F.sum("neg").over(inside)).alias("cum_neg"),
        (F.col("_rows_before") + F.row_number().over(inside)).alias("puesto"),
    )


def _totals(table: DataFrame) -> Column:
    return table.select(
        F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("rows"))
    ).scalar()


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve, equal scores counted half, with the base rate."""
    table = score_table(scored, score, label)
    total = F.col("all")
    below = total["neg"] - F.col("cum_neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return table.withColumn("all", _totals(table)).agg(
        F.try_divide(wins, F.max(total["pos"].cast("double") * total["neg"])).alias("roc_auc"),
        (F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("base_rate"),
    )


def roc_curve(scored: DataFrame, points: int = 200, score: str = "score", label: str = "label") -> DataFrame:
    """ROC points from (0, 0), thinned to about ``points``."""
    table = score_table(scored, score, label)
    total = F.col("all")
    step = F.greatest(F.lit(1), F.floor((total["rows"] + 1) / points).cast("long"))
    steps = table.withColumn("all", _totals(table)).filter(F.col("puesto") % step == 0).select(
        F.col("puesto").cast("long").alias("puesto"),
        (F.col("cum_neg") / total["neg"]).alias("fpr"),
        (F.col("cum_pos") / total["pos"]).alias("tpr"),
    )
    origin = table.groupBy().agg(F.lit(0).cast("long").alias("puesto")).select(
        "puesto", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(steps)


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum of precision over the steps of recall, equal scores taken together."""
    table = score_table(scored, score, label)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return table.agg(F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("pr_auc"))


def score_rank(scored: DataFrame, key: str, score: str = "score", name: str = "rango") -> DataFrame:
    """Rank of every row from the lowest score, equal scores in seeded-hash order of the key.

    Equal scores are split further by hash prefix: a score shared by a third of all rows is spread over
    thousands of small groups.
    """
    rows = scored.withColumns(
        {"_b": _bucket(F.col(score).cast("double")), "_h": seeded_hash(key, 0)}
    ).withColumn("_t", F.substring("_h", 1, TIE_DIGITS))
    cells = rows.groupBy("_b", score, "_t").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("_b").agg(F.sum("_n").alias("_size")).select(
        "_b", F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_b").orderBy(score, "_t").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(F.broadcast(starts), "_b").select(
        "_b", score, "_t", (F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_before")
    )
    within = Window.partitionBy("_b", score, "_t").orderBy("_h", key)
    return (
        rows.join(cells, ["_b", score, "_t"])
        .withColumn(name, F.col("_before") + F.row_number().over(within))
        .select(*scored.columns, name)
    )


def decile_lift(
    scored: DataFrame, key: str, bins: int = 10, score: str = "score", label: str = "label"
) -> DataFrame:
    """Rows, observed rate and mean score of equal-frequency score bins, best first."""
    ranked = score_rank(scored, key, score)
    n = scored.select(F.count(F.lit(1))).scalar()
    place = F.ceil((F.col("rango") - 1) * bins / F.greatest(n - 1, F.lit(1))) - 1
    return (
        ranked.withColumn("decile", F.greatest(F.lit(0), place).cast("int"))
        .groupBy("decile")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col(label).cast("double")).alias("rate"),
            F.avg(score).alias("avg_score"),
        )
        .orderBy(F.desc("decile"))
    )


def calibration(scored: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """Observed and predicted rate by score bin; bins include their upper edge, the first also zero."""
    chain = None
    for i in range(bins):
        under = F.col(score) <= (i + 1) * (1 / bins)
        chain = F.when(under, i) if chain is None else chain.when(under, i)
    return (
        scored.withColumn("bin", chain.otherwise(bins - 1))
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col(label).cast("double")).alias("obs_rate"),
            F.avg(score).alias("avg_pred"),
        )
        .orderBy("bin")
    )


def grouped_auc(scored: DataFrame, by: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """ROC-AUC of several score sets at once, each of any size: counts per score, carried from bucket to bucket."""
    counts = scored.groupBy(*by, F.col(score).alias("_score")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    return auc_of_counts(counts, by)


def auc_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC-AUC of several score sets from (by, _score, pos, neg), one row per distinct score.

    Starts of buckets are as many as there are sets and buckets: they are joined where the rows are, never collected for a broadcast.
    """
    counts = counts.withColumn("_b", _bucket(F.col("_score")))
    under = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy(*by, "_b").agg(F.sum("neg").alias("_neg")).select(
        *by, "_b", F.coalesce(F.sum("_neg").over(under), F.lit(0)).alias("_before")
    )
    below = Window.partitionBy(*by, "_b").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.col("_before") + F.coalesce(F.sum("neg").over(below), F.lit(0))
    return (
        counts.join(starts.hint("shuffle_hash"), [*by, "_b"])
        .withColumn("_wins", F.col("pos") * (lower + F.col("neg") / 2))
        .groupBy(*by)
        .agg(F.try_divide(F.sum("_wins"), F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))
    )
