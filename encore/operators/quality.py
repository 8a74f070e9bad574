"""Checks to read before any model is trained."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.places import COVERAGE_REGION_CITIES, UNMAPPED
from ..functions.ranking import exact_quantiles
from .lookups import lookup
from .trips import MORE_TRIPS, ONE_TRIP

# The features whose gaps are reported.
KEY_FEATURES = (
    "pais", "tipo_viaje", "product_type", "destino_trip", "origen_trip", "plataforma_trip_1", "flight_class",
    "rango_edad_primer_trip", "income", "bucket_anticipacion_compra", "bucket_duracion_viaje",
    "gross_bookings_usd", "flg_uso_cupon", "flg_tarjeta_credito",
)


def null_share_by_group(users: DataFrame, columns: Sequence[str] = KEY_FEATURES) -> DataFrame:
    """Percent of nulls of each column among one-trip users (A) and repeat buyers (B); columns that do not
    exist are listed with null shares."""
    present = [c for c in columns if c in users.columns]
    percent = lambda c, kind: 100 * F.avg(
        F.when(F.col("tipo_usuario") == kind, F.when(F.col(c).isNull(), 1.0).otherwise(0.0))
    )
    none = F.lit(None).cast("double")
    row = users.agg(
        *[percent(c, ONE_TRIP).alias(f"a_{c}") for c in present], *[percent(c, MORE_TRIPS).alias(f"b_{c}") for c in present]
    )
    entries = [
        F.struct(
            F.lit(c).alias("variable"),
            F.lit(c in present).alias("existe"),
            (F.col(f"a_{c}") if c in present else none).alias("pct_nulos_a"),
            (F.col(f"b_{c}") if c in present else none).alias("pct_nulos_b"),
        )
        for c in columns
    ]
    return row.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


MONEY_QUANTILES = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def money_profile(users: DataFrame, column: str = "gross_bookings_usd", large: float = 10_000.0) -> DataFrame:
    """Extremes, exact quantiles, and counts and shares of zero, negative and large values, in long form."""
    value = F.col(column)
    rows = users.filter(value.isNotNull())
    kinds = {"ceros": value == 0, "negativos": value < 0, "mayores": value > large}
    basic = {"min": F.min(value).cast("double"), "max": F.max(value).cast("double")}
    for name, condition in kinds.items():
        basic[f"n_{name}"] = F.sum(condition.cast("int")).cast("double")
        basic[f"pct_{name}"] = 100 * F.avg(condition.cast("int"))
    figures = rows.agg(*[c.alias(n) for n, c in basic.items()]).unpivot([], list(basic), "medida", "valor")
    names = None
    for name, p in MONEY_QUANTILES.items():
        hit = F.col("probability") == p
        names = F.when(hit, name) if names is None else names.when(hit, name)
    quantiles = exact_quantiles(rows, column, list(MONEY_QUANTILES.values()))
    return figures.unionByName(quantiles.select(names.alias("medida"), F.col("value").alias("valor")))


def cardinality_top5(
    users: DataFrame, columns: Mapping[str, str | None] = {"destino_trip": None, "destino_trip_2": MORE_TRIPS}, top: int = 5
) -> DataFrame:
    """Distinct values of each column and the percent of non-null rows its commonest values hold; a column may
    be limited to one user type."""
    entries = []
    for name, kind in columns.items():
        given = F.col(name).isNotNull()
        if kind is not None:
            given = given & (F.col("tipo_usuario") == kind)
        entries.append(F.when(given, F.struct(F.lit(name).alias("variable"), F.col(name).alias("valor"))))
    counts = (
        users.select(F.explode(F.array(*entries)).alias("e"))
        .filter("e IS NOT NULL")
        .groupBy("e.variable", "e.valor")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("variable").agg(F.count(F.lit(1)).alias("n_unicos"), F.sum("n").alias("_all"))
    order = Window.partitionBy("variable").orderBy(F.desc("n"), "valor")
    return (
        counts.withColumn("puesto", F.row_number().over(order))
        .filter(F.col("puesto") <= top)
        .join(F.broadcast(totals), "variable")
        .select("variable", "n_unicos", "puesto", "valor", (100 * F.col("n") / F.col("_all")).alias("pct"))
    )


def lookup_coverage(
    users: DataFrame,
    column: str = "destino_trip",
    cities: Mapping[str, str] = COVERAGE_REGION_CITIES,
    groups: int = 12,
    unmapped: int = 20,
) -> DataFrame:
    """Percent of users the map covers, its largest groups, and the commonest codes it lacks, in long form."""
    rows = users.select(F.col(column).alias("codigo"), lookup(column, cities, first_of_list=False).alias("grupo"))
    covered = rows.agg((100 * F.avg((F.col("grupo") != UNMAPPED).cast("int"))).alias("cifra"))

    def largest(df: DataFrame, by: str, report: str, top: int) -> DataFrame:
        return (
            df.groupBy(F.col(by).alias("valor"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "valor")
            .limit(top)
            .select(F.lit(report).alias("reporte"), "valor", F.col("n").cast("double").alias("cifra"))
        )

    missing = rows.filter((F.col("grupo") == UNMAPPED) & F.col("codigo").isNotNull())
    return (
        covered.select(F.lit("cobertura").alias("reporte"), F.lit(None).cast("string").alias("valor"), "cifra")
        .unionByName(largest(rows, "grupo", "grupo", groups))
        .unionByName(largest(missing, "codigo", "sin_mapear", unmapped))
    )


def constancy_check(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """For each column, the keys whose rows disagree on it; all must be 0 before rows are collapsed by key.

    Smallest and largest value decide, so no key's values are gathered.
    """
    per_key = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[(F.min(c) != F.max(c)).alias(c) for c in columns]
    )
    counts = per_key.agg(*[F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "variable", "claves_inconsistentes").withColumn("clave", F.lit(key))
