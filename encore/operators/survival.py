"""Time to the second purchase: Kaplan-Meier curves and log-rank tests.

Users are counted per group and day first, so every window below runs over at most one row per day.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_DAYS = 1096
# The days a curve is reported on, and the groups it is split by with their largest count.
GRID = tuple(
    sorted({*range(0, 31, 5), *range(30, 181, 15), *range(180, MAX_DAYS + 1, 30), 365, 730, MAX_DAYS})
)
GROUPS: Mapping[str, tuple[str, int]] = {
    "por_app": ("flg_app_90d_antes_trip1", 2),
    "por_pais": ("pais", 6),
    "por_producto": ("purchase_type", 5),
    "por_plataforma": ("plataforma_trip_1", 4),
    "por_loyalty": ("flg_uso_puntos", 2),
}
MIN_GROUP = 3000


def duration_event(view: DataFrame, max_days: int = MAX_DAYS) -> DataFrame:
    """T: days to the repeat, or days observed up to the limit; E: 1 if the repeat was seen in time."""
    again = F.col("rebuy_ever") & (F.col("dias_a_recompra") <= max_days)
    return view.filter("n_transacciones_trip1 IS NOT NULL").select(
        "social_id",
        F.when(again, F.col("dias_a_recompra"))
        .otherwise(F.least(F.col("dias_observados_desde_trip1"), F.lit(max_days)))
        .alias("T"),
        F.when(again, 1).otherwise(0).alias("E"),
        *dict.fromkeys(column for column, _ in GROUPS.values()),
    )


def day_counts(durations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return durations.groupBy(*by, F.col("T").alias("t")).agg(
        F.count(F.lit(1)).alias("leaving"), F.sum("E").alias("d")
    )


def _over(by: Sequence[str], order: Column) -> Window:
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order)


def curve_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Survival after each day on which anyone leaves; zero from the day on which all at risk repeat."""
    to_end = _over(by, F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = _over(by, F.asc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_risk = counts.withColumn("n", F.sum("leaving").over(to_end))
    wiped_out = F.max((F.col("d") == F.col("n")).cast("int")).over(so_far) == 1
    step = F.when(F.col("d") < F.col("n"), F.log1p(-F.col("d") / F.col("n"))).otherwise(0.0)
    return at_risk.select(
        *by, "t", "n", "d", F.when(wiped_out, 0.0).otherwise(F.exp(F.sum(step).over(so_far))).alias("s")
    )


def kaplan_meier(durations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve_from_counts(day_counts(durations, by), by)


def survival_on_grid(curve: DataFrame, grid: Sequence[int] = GRID, by: Sequence[str] = ()) -> DataFrame:
    """The step function at given days, 1.0 before the first step, to four places."""
    days = F.explode(F.array(*[F.lit(int(t)) for t in grid])).alias("t")
    heads = curve.select(*by).distinct() if by else curve.groupBy().agg(F.count(F.lit(1)).alias("_"))
    marks = heads.select(*by, days).withColumns({"s": F.lit(None).cast("double"), "mark": F.lit(1)})
    steps = curve.select(*by, "t", "s").withColumn("mark", F.lit(0))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("t", "mark")
    last = F.last("s", ignorenulls=True).over(order)
    return (
        steps.unionByName(marks)
        .withColumn("s", F.bround(F.coalesce(last, F.lit(1.0)), 4))
        .filter("mark = 1")
        .select(*by, "t", "s")
    )


def _group_day_counts(
    durations: DataFrame, groups: Mapping[str, tuple[str, int]], min_n: int
) -> DataFrame:
    """Day counts of the largest values of each grouping column, from one pass over the users."""
    entries = [
        F.struct(F.lit(key).alias("grupo"), F.col(column).cast("string").alias("valor"))
        for key, (column, _) in groups.items()
    ]
    counts = (
        durations.withColumn("_g", F.explode(F.array(*entries)))
        .filter("_g.valor IS NOT NULL")
        .groupBy(F.col("_g.grupo").alias("grupo"), F.col("_g.valor").alias("valor"), F.col("T").alias("t"))
        .agg(F.count(F.lit(1)).alias("leaving"), F.sum("E").alias("d"))
    )
    order = Window.partitionBy("grupo").orderBy(F.desc("n_total"), "valor")
    limit = F.create_map(*[F.lit(x) for key, (_, n) in groups.items() for x in (key, n)])
    widest = max(n for _, n in groups.values())
    largest = (
        counts.groupBy("grupo", "valor")
        .agg(F.sum("leaving").alias("n_total"), F.sum("d").alias("n_eventos"))
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= widest)
        .filter((F.col("_place") <= limit[F.col("grupo")]) & (F.col("n_total") >= min_n))
        .drop("_place")
    )
    return counts.join(F.broadcast(largest), ["grupo", "valor"])


def group_kaplan_meier(
    durations: DataFrame,
    groups: Mapping[str, tuple[str, int]] = GROUPS,
    min_n: int = MIN_GROUP,
    grid: Sequence[int] = GRID,
) -> DataFrame:
    """Curves of the largest groups on the grid, with group sizes and event counts."""
    counts = _group_day_counts(durations, groups, min_n)
    by = ["grupo", "valor", "n_total", "n_eventos"]
    return survival_on_grid(curve_from_counts(counts, by), grid, by)


def logrank_terms(
    durations: DataFrame, groups: Mapping[str, tuple[str, int]] = GROUPS, min_n: int = MIN_GROUP
) -> DataFrame:
    """Observed, expected and covariance of each pair of compared groups, summed over event days."""
    counts = _group_day_counts(durations, groups, min_n).select("grupo", "valor", "t", "leaving", "d")
    members = counts.select("grupo", "valor").distinct()
    event_days = counts.filter("d > 0").select("grupo", "t").distinct()
    # At most one row per compared value and day: values are limited by the group tops, days by the window.
    blanks = members.join(event_days, "grupo").withColumns({"leaving": F.lit(0), "d": F.lit(0)})
    filled = (
        counts.unionByName(blanks)
        .groupBy("grupo", "valor", "t")
        .agg(F.sum("leaving").alias("leaving"), F.sum("d").alias("d_i"))
    )
    to_end = Window.partitionBy("grupo", "valor").orderBy(F.desc("t")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    day = Window.partitionBy("grupo", "t")
    risk = (
        filled.withColumn("n_i", F.sum("leaving").over(to_end))
        .withColumns({"n": F.sum("n_i").over(day), "d": F.sum("d_i").over(day)})
        .filter("d > 0")
        .withColumn("p_i", F.col("n_i") / F.col("n"))
    )
    spread = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    left = risk.select("grupo", "t", "valor", "d_i", "d", "p_i", spread.alias("a"))
    right = risk.select("grupo", "t", F.col("valor").alias("valor_j"), F.col("p_i").alias("p_j"))
    same = (F.col("valor") == F.col("valor_j")).cast("double")
    return (
        left.join(right, ["grupo", "t"])
        .groupBy("grupo", "valor", "valor_j")
        .agg(
            F.sum("d_i").alias("observado"),
            F.sum(F.col("d") * F.col("p_i")).alias("esperado"),
            F.sum(F.col("a") * F.col("p_i") * (same - F.col("p_j"))).alias("covarianza"),
        )
    )


def chi_square_tail(x: float, df: int) -> float:
    """P(X >= x) of a chi-square variable, by its finite sum for whole degrees of freedom."""
    y = x / 2
    if df % 2 == 0:
        return math.exp(-y) * sum(y**i / math.factorial(i) for i in range(df // 2))
    tail = sum(y ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (df - 1) // 2 + 1))
    return math.erfc(math.sqrt(y)) + math.exp(-y) * tail


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    values = sorted(pdf["valor"].unique())
    cov = pdf.pivot(index="valor", columns="valor_j", values="covarianza").loc[values, values].to_numpy()
    own = pdf[pdf["valor"] == pdf["valor_j"]].set_index("valor").loc[values]
    z = (own["observado"] - own["esperado"]).to_numpy(dtype=float)[:-1]
    inner = cov[:-1, :-1]
    df = int(np.linalg.matrix_rank(inner, hermitian=True))
    if df == 0:
        chi2 = p = None
    else:
        chi2 = float(z @ (np.linalg.solve(inner, z) if df == len(z) else np.linalg.pinv(inner, hermitian=True) @ z))
        p = chi_square_tail(chi2, df)
    return pd.DataFrame({"grupo": [pdf["grupo"].iloc[0]], "grados": [df], "chi2": [chi2], "p_value": [p]})


def multivariate_logrank(
    durations: DataFrame, groups: Mapping[str, tuple[str, int]] = GROUPS, min_n: int = MIN_GROUP
) -> DataFrame:
    """Chi-square and p-value of each comparison; only the k x k terms of a comparison reach its solve.

    Groups that are never at risk beside another add nothing: the degrees of freedom are the rank of the covariance, and without
    any both values are null.
    """
    terms = logrank_terms(durations, groups, min_n)
    compared = terms.withColumn("_least", F.min("valor").over(Window.partitionBy("grupo"))).withColumn(
        "_most", F.max("valor").over(Window.partitionBy("grupo"))
    )
    return (
        compared.filter(F.col("_least") != F.col("_most"))
        .drop("_least", "_most")
        .groupBy("grupo")
        .applyInPandas(_solve, "grupo string, grados int, chi2 double, p_value double")
    )
