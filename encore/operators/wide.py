"""The wide table at detail grain and its controls."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.buckets import lead_time_bucket, trip_length_bucket
from .enrich import MEASURES, MEDIA_COLUMNS, PAYMENT_COLUMNS, PAYMENT_FLAGS

USER_PARTS = ("purchase_lists", "products", "trip2", "activity", "app")
TRANSACTION_PARTS = (
    "cabins", "media_path", "coupons", "clicks", "economics", "loyalty", "service", "payments",
)
TRAVELLER_COLUMNS = (
    "adultos_viaje", "ninos_viaje", "infantes_viaje", "cantidad_pasajeros_viaje", "tipo_viajero",
)
APP_COUNTERS = (
    "flg_app_90d_antes_trip1", "visitas_app_90d_antes_trip1", "flg_app_entre_trips",
    "visitas_app_entre_trips", "flg_app_90d_post_trip1", "visitas_app_90d_post_trip1",
)
SERVICE_COUNTERS = (
    "flg_customer_service", "cantidad_interacciones_cs", "cantidad_conversaciones_cs", "flg_cs_satisfecho",
    "flg_cs_neutro", "flg_cs_insatisfecho", "flg_cs_nps_na", "flg_cs_resuelto", "flg_cs_no_resuelto",
)
PROFILE_COLUMNS = (
    "birth_year", "edad_aprox_primer_trip", "rango_edad_primer_trip", "income", "nationality",
    "pais_residencia", "estado_residencia_codigo", "estado_residencia", "ciudad_residencia_id",
    "ciudad_residencia_codigo", "ciudad_residencia", "fecha_creacion_usuario",
    "antiguedad_usuario_dias_al_trip1", "geo_ultima_visita_ciudad", "geo_ultima_visita_pais",
    "geo_visita_frecuente_ciudad", "geo_visita_frecuente_pais", "geo_ultima_transaccion_ciudad",
    "geo_ultima_transaccion_pais",
)


def _by_entry(rows: DataFrame, key: str | list[str], entry: str, value: Column, name: str) -> DataFrame:
    """One row per key with a map entry -> value; entries per key are few (two trips, the product types)."""
    return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(entry, value))).alias(name))


def user_side(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All user tables as one row per user."""
    travellers = _by_entry(parts["travellers"], "social_id", "trip_id", F.struct(*TRAVELLER_COLUMNS), "_trips")
    rows = parts["profile"]
    for side in (*[parts[name] for name in USER_PARTS], travellers):
        rows = rows.join(side, "social_id", "left")
    return rows


def transaction_side(detail: DataFrame, parts: Mapping[str, DataFrame], *owner: str) -> DataFrame:
    """All transaction tables as one row per transaction (and owner, if one is named)."""
    people = parts["passengers"].filter("cantidad_pasajeros IS NOT NULL")
    keys = _transaction_keys(parts)
    passengers = _by_entry(people, keys, "product_type", F.col("cantidad_pasajeros"), "_passengers")
    rows = detail.filter("transaction_code IS NOT NULL").select(*dict.fromkeys([*keys, *owner])).distinct()
    for side in (*[parts[name] for name in TRANSACTION_PARTS], passengers):
        rows = rows.join(side, keys, "left")
    return rows


def _transaction_keys(parts: Mapping[str, DataFrame]) -> list[str]:
    """Transaction tables that carry their user are joined by it as well."""
    return [c for c in ("social_id", "transaction_code") if c in parts["economics"].columns]


def transactions_per_user(detail: DataFrame, parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row per user with a map from each of the user's transactions, which are few, to its side tables."""
    rows = transaction_side(detail, parts, "social_id")
    sides = F.struct(*[c for c in rows.columns if c not in ("social_id", "transaction_code")])
    return _by_entry(rows, "social_id", "transaction_code", sides, "_transactions")


def final_wide(
    detail: DataFrame, parts: Mapping[str, DataFrame], by_user: bool = False, keep: Callable[..., DataFrame] | None = None
) -> DataFrame:
    """Every detail row with its user, trip and transaction side tables.

    Side tables are put together first, one row per user and one per transaction, so no key can weigh more than
    another there. The detail rows then move twice, each time into a single join whose heavy keys Spark can split.

    ``by_user`` is for tables stored in buckets of users, without heavy ones: transactions come as a map per user, and the detail rows
    do not move at all. Where the transaction tables carry their user, as all of them or none must, nothing moves, and ``keep(key, name, build)`` may store the user and the transaction tables put together: steps are smaller then.
    """
    keys = _transaction_keys(parts)
    users, transactions = lambda: user_side(parts), lambda: transaction_side(detail, parts)
    if keep is not None:
        users, transactions = partial(keep, "social_id", "user_side", users), partial(keep, keys[0], "transaction_side", transactions)
    rows = detail.join(users(), "social_id", "left")
    if by_user and "social_id" not in keys:
        rows = rows.join(transactions_per_user(detail, parts), "social_id", "left")
        rows = rows.withColumn("_side", F.try_element_at("_transactions", F.col("transaction_code")))
        rows = rows.drop("_transactions").select("*", "_side.*").drop("_side")
    else:
        rows = rows.join(transactions(), keys, "left")
    rows = (
        rows.withColumn("_trip", F.try_element_at("_trips", F.col("trip_id")))
        .withColumns(
            {
                "cantidad_pasajeros": F.try_element_at("_passengers", F.col("product_type")),
                **{c: F.col("_trip")[c] for c in TRAVELLER_COLUMNS},
            }
        )
    )
    zero = lambda *names: [F.coalesce(n, F.lit(0)).alias(n) for n in names]
    return rows.select(
        "social_id", "nro_trip", "trip_id", "transaction_code", "purchase_type", "product_type", "pais",
        "tipo_viaje", "plataforma_compra", "canal_compra_agrupado", "plataforma_trip_1", "plataforma_trip_2",
        "canales_compra_trip_1", "canales_compra_trip_2", "origen_trip", "destino_trip", "flight_class",
        "destino_trip_2", "origen_trip_2", "tipo_viaje_2", "duracion_viaje_dias_2",
        "dias_anticipacion_compra_2", "gross_bookings_usd_2", *zero("flg_uso_cupon_2"), "flight_class_2",
        "reservation_date", "reservation_datetime", "fecha_primer_trip", "fecha_segundo_trip", "tipo_usuario",
        *PROFILE_COLUMNS,
        "trip_checkin", "trip_checkout", "dias_anticipacion_compra_checkin", "duracion_viaje_dias",
        lead_time_bucket("dias_anticipacion_compra_checkin").alias("bucket_anticipacion_compra"),
        trip_length_bucket("duracion_viaje_dias").alias("bucket_duracion_viaje"),
        F.datediff("fecha_segundo_trip", "fecha_primer_trip").alias("dias_entre_trip_1_y_2"),
        "cantidad_pasajeros", *TRAVELLER_COLUMNS,
        *zero(*APP_COUNTERS), "ultima_visita_app_antes_trip1", "ultima_visita_app_antes_trip2",
        "first_click_datetime", "first_click_event_type", "last_click_datetime", "last_click_event_type",
        *MEASURES,
        F.coalesce("puntos_usados", F.lit(0.0)).alias("puntos_usados"), *zero("flg_uso_puntos"),
        "tier_redencion_raw", "tier_al_momento_redencion",
        "metodos_pago", "bancos_tarjeta", "tiers_tarjeta", "cantidad_pagos", "cantidad_instrumentos_pago",
        "cantidad_tipos_pago", "flg_multi_instrumento_pago", "flg_multi_tipo_pago", "gb_total_payments",
        *[f"gb_{n}" for n in PAYMENT_COLUMNS], *[f"pct_gb_{n}" for n in PAYMENT_COLUMNS],
        *zero(*PAYMENT_FLAGS.values()),
        *zero(*SERVICE_COUNTERS), "avg_agent_empathy_cs", "min_agent_empathy_cs", "max_agent_empathy_cs",
        "productos_trip_1", "productos_trip_2", *zero("flg_mismo_producto_trip_1_2"),
        *zero("flg_uso_cupon", "cantidad_visitas_entre_trips", "cantidad_searches_entre_trips"),
        *zero(*MEDIA_COLUMNS, "eventos_path_total"),
    )


def lead_and_length_buckets(detail: DataFrame) -> DataFrame:
    """Detail rows with the two day counts and their buckets."""
    return detail.select(
        "social_id",
        "trip_id",
        "transaction_code",
        "product_type",
        "dias_anticipacion_compra_checkin",
        "duracion_viaje_dias",
        lead_time_bucket("dias_anticipacion_compra_checkin").alias("bucket_anticipacion_compra"),
        trip_length_bucket("duracion_viaje_dias").alias("bucket_duracion_viaje"),
    )


def wide_controls(wide: DataFrame, payments: DataFrame, app: DataFrame, profile: DataFrame) -> DataFrame:
    """Controls in long form (control, level, measure, amount): row counts against distinct keys,
    completeness, trip types, date validity and totals."""

    def long(df: DataFrame, control: str, measures: Mapping[str, object], level: str | None = None) -> DataFrame:
        keyed = df.groupBy(F.col(level).alias("level")) if level else df.groupBy(F.lit(None).cast("string").alias("level"))
        wide_row = keyed.agg(*[m.alias(n) for n, m in measures.items()])
        return wide_row.unpivot(["level"], list(measures), "measure", "amount").select(
            F.lit(control).alias("control"), "level", "measure", F.col("amount").cast("long").alias("amount")
        )

    rows = F.count(F.lit(1))
    distinct = lambda name: F.countDistinct(name)
    users_with = lambda condition: F.countDistinct(F.when(condition, F.col("social_id")))
    has = lambda name: F.col(name).isNotNull()
    filled = lambda condition: F.count(F.when(condition, 1))
    blocks = [
        long(payments, "pagos", {"filas": rows, "transacciones": distinct("transaction_code")}),
        long(
            app,
            "app",
            {
                "filas": rows,
                "socials": distinct("social_id"),
                "users_app_90d_antes_trip1": users_with(F.col("flg_app_90d_antes_trip1") == 1),
                "users_app_entre_trips": users_with(F.col("flg_app_entre_trips") == 1),
                "users_app_90d_post_trip1": users_with(F.col("flg_app_90d_post_trip1") == 1),
            },
        ),
        long(
            profile,
            "perfil",
            {
                "filas": rows,
                "socials": distinct("social_id"),
                "users_con_edad": users_with(has("edad_aprox_primer_trip")),
                "users_con_income": users_with(has("income")),
                "users_con_pais_residencia": users_with(has("pais_residencia")),
                "users_con_estado_residencia": users_with(has("estado_residencia")),
                "users_con_ciudad_residencia": users_with(has("ciudad_residencia")),
                "users_con_geo_frecuente": users_with(has("geo_visita_frecuente_ciudad")),
            },
        ),
        long(
            wide,
            "tipo_viaje",
            {"filas": rows, "usuarios": distinct("social_id"), "transacciones": distinct("transaction_code")},
            level="tipo_viaje",
        ),
        long(
            wide,
            "fechas_viaje",
            {
                "filas": rows,
                "con_checkin": filled(has("trip_checkin")),
                "con_checkout": filled(has("trip_checkout")),
                "con_anticipacion": filled(has("dias_anticipacion_compra_checkin")),
                "anticipacion_invalida": filled(F.col("dias_anticipacion_compra_checkin") < 0),
                "con_duracion": filled(has("duracion_viaje_dias")),
                "duracion_invalida": filled(F.col("duracion_viaje_dias") < 0),
            },
        ),
        long(
            wide,
            "final",
            {
                "filas_final": rows,
                "usuarios": distinct("social_id"),
                "transacciones": distinct("transaction_code"),
            },
        ),
    ]
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out


SAMPLE_ORDER = ("social_id", "nro_trip", "reservation_datetime", "transaction_code", "product_type")


def wide_sample(wide: DataFrame, limit: int = 100) -> DataFrame:
    """The first rows in a fixed order; rows equal on the order are told apart by destination and origin."""
    return wide.orderBy(*SAMPLE_ORDER, "destino_trip", "origen_trip", "purchase_type").limit(limit)
