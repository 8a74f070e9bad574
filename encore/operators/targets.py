"""Targets that respect how long each user was observed, and the user modelling view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .trips import months_after

HORIZONS = (6, 12, 18, 24, 36)
MIN_DATE = "2022-01-01"
MARGIN_SINCE = "2020-01-01"
MEDIA_SINCE = "2021-01-01"


def _date(text: str) -> Column:
    return F.lit(text).cast("date")


def observation_end(users: DataFrame, as_of: str | None = None) -> Column:
    """The last day a first trip was seen, as one scalar for the whole plan."""
    if as_of is not None:
        return _date(as_of)
    return users.select(F.max("fecha_primer_trip")).scalar()


def target_columns(end: Column, horizons: Sequence[int]) -> dict[str, Column]:
    first, second = F.col("fecha_primer_trip"), F.col("fecha_segundo_trip")
    columns = {}
    for h in horizons:
        columns[f"eligible_{h}m"] = first <= months_after(end, -h)
        columns[f"rebuy_{h}m"] = second.isNotNull() & (second <= months_after(first, h))
    return columns


def horizon_targets(users: DataFrame, horizons: Sequence[int] = HORIZONS, as_of: str | None = None) -> DataFrame:
    """Per user and horizon: was the whole horizon observed, and was there a second trip within it?"""
    end = observation_end(users, as_of)
    columns = target_columns(end, horizons)
    return users.select(
        "social_id", "fecha_primer_trip", "fecha_segundo_trip", *[c.alias(n) for n, c in columns.items()]
    )


def _repeat_within(days: int) -> Column:
    gap = F.datediff("fecha_segundo_trip", "fecha_primer_trip")
    return F.col("fecha_segundo_trip").isNotNull() & (gap <= days)


def contamination_columns(days: int = 90) -> dict[str, Column]:
    """The post-trip window overlaps the target for fast repeaters: mark them and blank their features."""
    mixed = _repeat_within(days)
    columns = {"flg_contaminado_90d_app": mixed}
    for name in ("flg_app_90d_post_trip1", "visitas_app_90d_post_trip1"):
        columns[f"{name}_leakfree"] = F.when(~mixed, F.col(name))
    return columns


def contamination_mask(users: DataFrame, days: int = 90) -> DataFrame:
    columns = contamination_columns(days)
    return users.select(
        "social_id", "flg_app_90d_post_trip1", "visitas_app_90d_post_trip1",
        *[c.alias(n) for n, c in columns.items()],
    )


def coverage_columns(margin_since: str = MARGIN_SINCE, media_since: str = MEDIA_SINCE) -> dict[str, Column]:
    first = F.col("fecha_primer_trip")
    return {
        "cohorte_con_margin_valido": first >= _date(margin_since),
        "cohorte_con_path_medios_valido": first >= _date(media_since),
    }


def coverage_validity_flags(
    users: DataFrame, margin_since: str = MARGIN_SINCE, media_since: str = MEDIA_SINCE
) -> DataFrame:
    """Which cohorts have usable margin and media-path data."""
    return users.select(
        "social_id",
        "fecha_primer_trip",
        *[c.alias(n) for n, c in coverage_columns(margin_since, media_since).items()],
    )


TRIP1_FEATURES = (
    "pais", "purchase_type", "product_type", "origen_trip", "destino_trip", "flight_class", "tipo_viaje",
    "birth_year", "edad_aprox_primer_trip", "rango_edad_primer_trip", "income", "nationality", "pais_residencia",
    "estado_residencia", "ciudad_residencia", "antiguedad_usuario_dias_al_trip1", "geo_ultima_visita_ciudad",
    "geo_ultima_visita_pais", "geo_visita_frecuente_ciudad", "geo_visita_frecuente_pais", "trip_checkin",
    "trip_checkout", "dias_anticipacion_compra_checkin", "bucket_anticipacion_compra", "duracion_viaje_dias",
    "bucket_duracion_viaje", "flg_uso_cupon", "flg_uso_puntos", "puntos_usados", "tier_al_momento_redencion",
    "metodos_pago", "flg_tarjeta_credito", "flg_transferencia", "flg_deposito_bancario", "flg_puntos_loyalty_pago",
    "flg_cupon_pago", "flg_cash", "flg_multi_instrumento_pago", "flg_multi_tipo_pago", "n_transacciones_trip1",
    "gross_bookings_usd", "cost_usd", "margin_variable_usd", "net_revenues_usd", "npv_usd", "fee_net_usd",
    "gb_total_payments", "eventos_directo", "eventos_sem_seo_kwbrand", "eventos_metabuscadores", "eventos_crm",
    "eventos_otros", "eventos_path_total", "first_click_datetime", "last_click_datetime", "first_click_event_type",
    "last_click_event_type",
)
AFTER_TRIP1 = ("flg_app_90d_post_trip1", "visitas_app_90d_post_trip1")
BETWEEN_TRIPS = (
    "cantidad_visitas_entre_trips", "cantidad_searches_entre_trips", "flg_app_entre_trips",
    "visitas_app_entre_trips", "ultima_visita_app_antes_trip2", "plataforma_trip_2", "canales_compra_trip_2",
    "productos_trip_1", "productos_trip_2", "flg_mismo_producto_trip_1_2",
)
SERVICE = (
    "flg_customer_service", "cantidad_interacciones_cs", "flg_cs_satisfecho", "flg_cs_insatisfecho",
    "flg_cs_resuelto", "flg_cs_no_resuelto", "avg_agent_empathy_cs",
)


def modeling_view(
    users: DataFrame,
    trip1: DataFrame,
    min_date: str = MIN_DATE,
    horizons: Sequence[int] = HORIZONS,
    as_of: str | None = None,
    margin_since: str = MARGIN_SINCE,
    media_since: str = MEDIA_SINCE,
    contamination_days: int = 90,
) -> DataFrame:
    """One row per user: targets, trip-1 features, marked post-trip features and descriptive columns."""
    end = observation_end(users, as_of)
    first, second = F.col("fecha_primer_trip"), F.col("fecha_segundo_trip")
    rows = users.filter(first >= _date(min_date)).join(trip1, "social_id", "left")
    named = lambda columns: [c.alias(n) for n, c in columns.items()]
    platforms = F.coalesce("plataforma_trip_1", F.lit(""))
    return rows.select(
        "social_id", "tipo_usuario", "fecha_primer_trip", "fecha_segundo_trip",
        second.isNotNull().alias("rebuy_ever"),
        F.datediff(second, first).alias("dias_a_recompra"),
        F.datediff(end, first).alias("dias_observados_desde_trip1"),
        F.date_format(first, "yyyy").alias("cohort_year"),
        F.date_format(first, "yyyy-MM").alias("cohort_month"),
        *named(target_columns(end, horizons)),
        F.coalesce("plataforma_trip_1", "plataforma_compra_tx1").alias("plataforma_trip_1"),
        F.coalesce("canales_compra_trip_1", "canal_compra_agrupado_tx1").alias("canales_compra_trip_1"),
        platforms.contains("|").alias("flg_multi_plataforma_trip1"),
        F.col("flight_class").isNotNull().alias("tiene_vuelo"),
        *TRIP1_FEATURES,
        *named(coverage_columns(margin_since, media_since)),
        "flg_app_90d_antes_trip1", "visitas_app_90d_antes_trip1", "ultima_visita_app_antes_trip1",
        F.when(
            F.col("flg_app_90d_antes_trip1") == 1,
            F.datediff(first, F.col("ultima_visita_app_antes_trip1").cast("date")),
        ).alias("dias_desde_ultima_visita_app_antes_trip1"),
        *AFTER_TRIP1,
        *named(contamination_columns(contamination_days)),
        *BETWEEN_TRIPS,
        *SERVICE,
    )


# When each column becomes known. A = at trip 1, B = later but in a window that can be cut,
# C = only if trip 2 happened, D = descriptive, coverage or timing unresolved.
LEAKAGE_GROUPS: Mapping[str, tuple[str, ...]] = {
    "A": (
        "fecha_primer_trip", "cohort_year", "cohort_month", "dias_observados_desde_trip1", "plataforma_trip_1",
        "canales_compra_trip_1", "flg_multi_plataforma_trip1", "tiene_vuelo", *TRIP1_FEATURES,
        "cohorte_con_margin_valido", "cohorte_con_path_medios_valido", "flg_app_90d_antes_trip1",
        "visitas_app_90d_antes_trip1", "ultima_visita_app_antes_trip1",
        "dias_desde_ultima_visita_app_antes_trip1", "productos_trip_1",
    ),
    "B": (*AFTER_TRIP1, *[f"{c}_leakfree" for c in AFTER_TRIP1]),
    "C": (
        "fecha_segundo_trip", "tipo_usuario", "rebuy_ever", "dias_a_recompra", "dias_entre_trip_1_y_2",
        "flg_contaminado_90d_app", *[c for c in BETWEEN_TRIPS if c != "productos_trip_1"],
    ),
    "D": SERVICE,
    "id": ("social_id",),
}
DERIVED_FEATURES = {
    "plataforma_principal": "A", "canal_principal": "A", "flight_class_simple": "A", "log_gross_bookings": "A",
    "log_gb_usd": "A",
}


class LeakageError(ValueError):
    """A feature list holds columns that would reveal the target."""


def leakage_group(column: str) -> str | None:
    """Group of a column; targets count as C, unknown columns have none."""
    if column.startswith(("rebuy_", "eligible_")):
        return "C"
    if column in DERIVED_FEATURES:
        return DERIVED_FEATURES[column]
    return next((group for group, names in LEAKAGE_GROUPS.items() if column in names), None)


def leakage_guard(features: Sequence[str], allowed: Sequence[str] = ("A",)) -> list[str]:
    """The feature list, or an error that names every column outside the allowed groups."""
    bad = [f"{c} ({leakage_group(c) or 'unknown'})" for c in features if leakage_group(c) not in allowed]
    if bad:
        raise LeakageError("not usable as features: " + ", ".join(bad))
    return list(features)


def leakage_report(view: DataFrame, allowed: Sequence[str] = ("A",)) -> DataFrame:
    """Each column of a table with its group, whether it may be a feature, and how many rows have it."""
    counts = view.agg(*[F.count(c).alias(c) for c in view.columns])
    long = counts.unpivot([], list(view.columns), "variable", "n_con_dato")
    group = F.lit(None).cast("string")
    for column in view.columns:
        known = leakage_group(column)
        if known is not None:
            group = F.when(F.col("variable") == column, known).otherwise(group)
    return long.withColumn("grupo", group).withColumn(
        "usable", F.coalesce(F.col("grupo").isin(*allowed), F.lit(False))
    )
