"""Feature preparation and city lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.aggregates import as_col
from ..functions.places import DESTINATION_KIND_CITIES, REGION_CITIES, UNMAPPED
from ..functions.text import first_item
from .trips import MORE_TRIPS

NO_FLIGHT = "Sin vuelo"
UNKNOWN_INCOME = "Unknown"


def impute_and_log(users: DataFrame) -> DataFrame:
    """Constants for missing origin, cabin and income; bookings cut at zero, with their log1p."""
    money = F.greatest(F.col("gross_bookings_usd").cast("double"), F.lit(0.0))
    money = F.when(F.col("gross_bookings_usd").isNotNull(), money)
    return users.withColumns(
        {
            "origen_trip": F.coalesce("origen_trip", F.lit(NO_FLIGHT)),
            "flight_class": F.coalesce("flight_class", F.lit(NO_FLIGHT)),
            "income": F.coalesce("income", F.lit(UNKNOWN_INCOME)),
            "gross_bookings_usd": money,
            "log_gb_usd": F.log1p(money),
        }
    )


def lookup(code: str | Column, cities: Mapping[str, str], first_of_list: bool = True) -> Column:
    """Group of a city code, ``OTRO`` if it has none.

    The map is a constant of under 200 entries, so it travels inside the plan and needs no join. A list
    'A | B' is looked up by its first entry unless ``first_of_list`` is false.
    """
    code = first_item(code) if first_of_list else as_col(code)
    table = F.create_map(*[F.lit(x) for pair in cities.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(UNMAPPED))


def with_regions(
    users: DataFrame, cities: Mapping[str, str] = REGION_CITIES, first_of_list: bool = True
) -> DataFrame:
    return users.withColumns(
        {
            "region_destino": lookup("destino_trip", cities, first_of_list),
            "region_destino_2": lookup("destino_trip_2", cities, first_of_list),
        }
    )


def with_destination_types(
    users: DataFrame, cities: Mapping[str, str] = DESTINATION_KIND_CITIES, first_of_list: bool = True
) -> DataFrame:
    return users.withColumns(
        {
            "tipo_destino": lookup("destino_trip", cities, first_of_list),
            "tipo_destino_2": lookup("destino_trip_2", cities, first_of_list),
        }
    )


def region_lookup(users: DataFrame, first_of_list: bool = True) -> DataFrame:
    return with_regions(users, first_of_list=first_of_list).select(
        "social_id", "tipo_usuario", "destino_trip", "destino_trip_2", "region_destino", "region_destino_2"
    )


def destination_type_lookup(users: DataFrame, first_of_list: bool = True) -> DataFrame:
    return with_destination_types(users, first_of_list=first_of_list).select(
        "social_id", "tipo_usuario", "destino_trip", "destino_trip_2", "tipo_destino", "tipo_destino_2"
    )


def _counts(df: DataFrame, column: str, report: str, top: int | None = None) -> DataFrame:
    counted = df.groupBy(F.col(column).alias("valor")).agg(F.count(F.lit(1)).alias("n"))
    if top is not None:
        counted = counted.orderBy(F.desc("n"), "valor").limit(top)
    return counted.select(F.lit(report).alias("reporte"), "valor", "n")


def region_report(users: DataFrame, top: int = 10) -> DataFrame:
    """Coverage counts of the region map and the commonest regions of both trips."""
    rows = with_regions(users)
    covered = lambda name: F.sum((F.col(name) != UNMAPPED).cast("int"))
    totals = rows.agg(
        F.count(F.lit(1)).alias("usuarios"),
        covered("region_destino").alias("region_destino"),
        covered("region_destino_2").alias("region_destino_2"),
    ).unpivot([], ["usuarios", "region_destino", "region_destino_2"], "valor", "n")
    return (
        totals.select(F.lit("cobertura").alias("reporte"), "valor", "n")
        .unionByName(_counts(rows, "region_destino", "top_region_destino", top))
        .unionByName(
            _counts(rows.filter(F.col("tipo_usuario") == MORE_TRIPS), "region_destino_2", "top_region_destino_2", top)
        )
    )


def destination_type_report(users: DataFrame, top: int = 20) -> DataFrame:
    """Distribution of destination types of both trips and the commonest first destinations without one."""
    rows = with_destination_types(users)
    missing = rows.filter((F.col("tipo_destino") == UNMAPPED) & F.col("destino_trip").isNotNull())
    return (
        _counts(rows, "tipo_destino", "tipo_destino")
        .unionByName(_counts(rows, "tipo_destino_2", "tipo_destino_2"))
        .unionByName(_counts(missing, "destino_trip", "sin_mapear", top))
    )
