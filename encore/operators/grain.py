"""Collapsing the wide table to transaction and user grain."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.aggregates import first_by, last_by, set_size
from ..functions.text import real, whole
from .trips import MORE_TRIPS

# Columns by how they are carried to the coarser grain.
ROW_ORDER = ("reservation_datetime", "trip_id", "product_type")
TX_EARLIEST_TEXT = (
    "social_id", "nro_trip", "trip_id", "purchase_type", "pais", "plataforma_compra", "canal_compra_agrupado",
    "origen_trip", "destino_trip", "flight_class", "product_type", "tipo_viaje", "rango_edad_primer_trip",
    "income", "nationality", "pais_residencia", "estado_residencia", "ciudad_residencia",
    "geo_ultima_visita_ciudad", "geo_ultima_visita_pais", "geo_visita_frecuente_ciudad",
    "geo_visita_frecuente_pais", "bucket_anticipacion_compra", "bucket_duracion_viaje",
    "first_click_event_type",
)
TX_EARLIEST_WHOLE = (
    "birth_year", "edad_aprox_primer_trip", "antiguedad_usuario_dias_al_trip1",
    "dias_anticipacion_compra_checkin", "duracion_viaje_dias",
)
TX_EARLIEST_DATE = ("trip_checkin", "trip_checkout")
TX_LATEST = ("tier_redencion_raw", "tier_al_momento_redencion", "metodos_pago", "last_click_event_type")
TX_MAX_WHOLE = (
    "flg_uso_cupon", "flg_uso_puntos", "cantidad_pagos", "cantidad_instrumentos_pago", "cantidad_tipos_pago",
    "flg_multi_instrumento_pago", "flg_multi_tipo_pago", "flg_tarjeta_credito", "flg_transferencia",
    "flg_deposito_bancario", "flg_puntos_loyalty_pago", "flg_cupon_pago", "flg_cash", "flg_customer_service",
    "cantidad_interacciones_cs", "cantidad_conversaciones_cs", "flg_cs_satisfecho", "flg_cs_insatisfecho",
    "flg_cs_resuelto", "flg_cs_no_resuelto", "eventos_directo", "eventos_sem_seo_kwbrand",
    "eventos_metabuscadores", "eventos_crm", "eventos_otros", "eventos_path_total",
)
TX_MAX_REAL = {
    "puntos_usados": "puntos_usados",
    "gb_total_payments": "gb_total_payments",
    "pct_gb_tarjeta_credito": "pct_gb_tarjeta_credito",
    "pct_gb_transferencia": "pct_gb_transferencia",
    "pct_gb_deposito_bancario": "pct_gb_deposito_bancario",
    "pct_gb_puntos_loyalty": "pct_gb_puntos_loyalty",
    "pct_gb_cupon": "pct_gb_cupon",
    "pct_gb_cash": "pct_gb_cash",
    "avg_agent_empathy_cs": "avg_agent_empathy_cs",
    "gross_bookings_usd": "gross_bookings_usd",
    "cost_usd": "cost_usd",
    "margin_variable_without_mkt_net_usd": "margin_variable_usd",
    "net_revenues_usd": "net_revenues_usd",
    "npv_without_mkt_net_usd": "npv_usd",
    "fee_net_usd": "fee_net_usd",
}


def tx_level(wide: DataFrame, owner: str | None = None) -> DataFrame:
    """One row per transaction; numbers given as text are parsed, and unreadable ones become null.

    ``owner`` names a column that is the same on all rows of a transaction. Grouping by it as well changes no row, and needs no
    shuffle where the table is stored in its buckets.
    """
    early = lambda value: first_by(value, *ROW_ORDER)
    stamp = lambda name: F.col(name).try_cast("timestamp_ntz")
    rows = wide.filter("transaction_code IS NOT NULL").withColumn(
        "reservation_datetime", stamp("reservation_datetime")
    )
    keys = ["transaction_code"] if owner is None else [owner, "transaction_code"]
    found = rows.groupBy(*keys).agg(
        F.min(F.col("reservation_date").cast("date")).alias("reservation_date"),
        F.min("reservation_datetime").alias("reservation_datetime"),
        *[early(c).alias(c) for c in TX_EARLIEST_TEXT if c not in ("nro_trip", owner)],
        early(whole("nro_trip")).alias("nro_trip"),
        set_size("product_type").alias("n_product_types"),
        *[early(whole(c)).alias(c) for c in TX_EARLIEST_WHOLE],
        *[early(F.col(c).try_cast("date")).alias(c) for c in TX_EARLIEST_DATE],
        *[last_by(c, *ROW_ORDER).alias(c) for c in TX_LATEST],
        *[F.max(whole(c)).alias(c) for c in TX_MAX_WHOLE],
        *[F.max(real(source)).alias(name) for source, name in TX_MAX_REAL.items()],
        F.min(stamp("first_click_datetime")).alias("first_click_datetime"),
        F.max(stamp("last_click_datetime")).alias("last_click_datetime"),
    )
    if owner is None:
        return found
    texts = [c for c in TX_EARLIEST_TEXT if c != "nro_trip"]
    rest = [c for c in found.columns if c not in (*texts, "transaction_code", "reservation_date", "reservation_datetime")]
    return found.select("transaction_code", "reservation_date", "reservation_datetime", *texts, *rest)


USER_ORDER = ("reservation_datetime", "transaction_code", "product_type")
USER_EARLIEST = (
    "tipo_usuario", "plataforma_trip_1", "plataforma_trip_2", "canales_compra_trip_1", "canales_compra_trip_2",
    "productos_trip_1", "productos_trip_2",
)
USER_MAX_WHOLE = (
    "flg_app_90d_antes_trip1", "visitas_app_90d_antes_trip1", "flg_app_entre_trips", "visitas_app_entre_trips",
    "flg_app_90d_post_trip1", "visitas_app_90d_post_trip1", "cantidad_visitas_entre_trips",
    "cantidad_searches_entre_trips", "flg_mismo_producto_trip_1_2",
)
USER_MAX_STAMP = ("ultima_visita_app_antes_trip1", "ultima_visita_app_antes_trip2")


def user_level(wide: DataFrame) -> DataFrame:
    """One row per user with the columns that do not change between a user's rows."""
    rows = wide.filter("social_id IS NOT NULL").withColumn(
        "reservation_datetime", F.col("reservation_datetime").try_cast("timestamp_ntz")
    )
    return rows.groupBy("social_id").agg(
        *[F.min(F.col(c).cast("date")).alias(c) for c in ("fecha_primer_trip", "fecha_segundo_trip")],
        *[first_by(c, *USER_ORDER).alias(c) for c in USER_EARLIEST],
        *[F.max(whole(c)).alias(c) for c in USER_MAX_WHOLE],
        *[F.max(F.col(c).try_cast("timestamp_ntz")).alias(c) for c in USER_MAX_STAMP],
    )


TRIP1_ORDER = ("reservation_datetime", "transaction_code")
TRIP1_EARLIEST = {
    **{
        c: c
        for c in (
            "pais", "purchase_type", "product_type", "origen_trip", "destino_trip", "flight_class", "tipo_viaje",
            "birth_year", "edad_aprox_primer_trip", "rango_edad_primer_trip", "income", "nationality",
            "pais_residencia", "estado_residencia", "ciudad_residencia", "antiguedad_usuario_dias_al_trip1",
            "geo_ultima_visita_ciudad", "geo_ultima_visita_pais", "geo_visita_frecuente_ciudad",
            "geo_visita_frecuente_pais", "trip_checkin", "trip_checkout", "dias_anticipacion_compra_checkin",
            "bucket_anticipacion_compra", "duracion_viaje_dias", "bucket_duracion_viaje",
        )
    },
    "plataforma_compra": "plataforma_compra_tx1",
    "canal_compra_agrupado": "canal_compra_agrupado_tx1",
}
TRIP1_LATEST = ("tier_al_momento_redencion", "metodos_pago")
TRIP1_FLAGS = (
    "flg_uso_cupon", "flg_uso_puntos", "flg_tarjeta_credito", "flg_transferencia", "flg_deposito_bancario",
    "flg_puntos_loyalty_pago", "flg_cupon_pago", "flg_cash", "flg_multi_instrumento_pago", "flg_multi_tipo_pago",
    "flg_customer_service", "flg_cs_satisfecho", "flg_cs_insatisfecho", "flg_cs_resuelto", "flg_cs_no_resuelto",
)
TRIP1_SUMS = (
    "puntos_usados", "gross_bookings_usd", "cost_usd", "margin_variable_usd", "net_revenues_usd", "npv_usd",
    "fee_net_usd", "gb_total_payments", "cantidad_interacciones_cs", "eventos_directo", "eventos_sem_seo_kwbrand",
    "eventos_metabuscadores", "eventos_crm", "eventos_otros", "eventos_path_total",
)


def trip1_agg(transactions: DataFrame) -> DataFrame:
    """Each user's first trip: additive measures summed over transactions, flags or-ed, attributes of the
    earliest transaction."""
    return (
        transactions.filter("nro_trip = 1")
        .groupBy("social_id")
        .agg(
            F.count(F.lit(1)).alias("n_transacciones_trip1"),
            F.min("reservation_datetime").alias("trip1_primera_transaccion_dt"),
            *[first_by(c, *TRIP1_ORDER).alias(name) for c, name in TRIP1_EARLIEST.items()],
            *[last_by(c, *TRIP1_ORDER).alias(c) for c in TRIP1_LATEST],
            *[F.max(c).alias(c) for c in TRIP1_FLAGS],
            *[F.sum(c).alias(c) for c in TRIP1_SUMS],
            F.avg("avg_agent_empathy_cs").alias("avg_agent_empathy_cs"),
            F.min("first_click_datetime").alias("first_click_datetime"),
            first_by("first_click_event_type", "first_click_datetime").alias("first_click_event_type"),
            F.max("last_click_datetime").alias("last_click_datetime"),
            last_by("last_click_event_type", "last_click_datetime").alias("last_click_event_type"),
        )
    )


EXPORT_FIRST = (
    "tipo_usuario", "fecha_primer_trip", "fecha_segundo_trip", "pais", "tipo_viaje", "product_type",
    "purchase_type", "destino_trip", "origen_trip", "plataforma_trip_1", "canales_compra_trip_1", "flight_class",
    "rango_edad_primer_trip", "income", "bucket_anticipacion_compra", "bucket_duracion_viaje",
    "duracion_viaje_dias", "dias_anticipacion_compra_checkin", "trip_checkin", "trip_checkout",
    "productos_trip_1", "destino_trip_2", "origen_trip_2", "tipo_viaje_2", "productos_trip_2",
    "duracion_viaje_dias_2", "dias_anticipacion_compra_2", "gross_bookings_usd_2", "flg_uso_cupon_2",
    "flight_class_2", "plataforma_trip_2", "canales_compra_trip_2", "flg_mismo_producto_trip_1_2",
)
EXPORT_FLAGS = ("flg_uso_cupon", "flg_tarjeta_credito", "flg_transferencia", "flg_puntos_loyalty_pago")
EXPORT_COLUMNS = (
    "social_id", "nro_trip", "transaction_code", "reservation_datetime", "gross_bookings_usd",
    *EXPORT_FIRST, *EXPORT_FLAGS,
)
EXPORT_ORDER = ("reservation_datetime", "transaction_code", "product_type")


def user_grain_latest_file(
    rows: DataFrame,
    year: str = "archivo_anio",
    month: str = "archivo_mes",
    order: tuple[str, ...] = EXPORT_ORDER,
    fan_out: bool = False,
) -> DataFrame:
    """One row per user from monthly exports: the user's trip-1 rows in the newest file that has any.

    Bookings are added once per transaction; ``fan_out=True`` adds them once per product row instead. The
    newest file is picked by an aggregate, so no user's rows are gathered and sorted.
    """
    first = [(c, "flg_mismo_producto" if c == "flg_mismo_producto_trip_1_2" else c) for c in EXPORT_FIRST]
    keys = ["social_id", year, month]
    packed = lambda c: F.min(
        F.when(F.col(c).isNotNull(), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(order)], F.col(c).alias("v")))
    )
    trip1 = rows.filter("nro_trip = 1 AND social_id IS NOT NULL")
    money = F.sum("gross_bookings_usd") if fan_out else F.max("gross_bookings_usd")
    per_transaction = trip1.groupBy(*keys, "transaction_code").agg(
        *[packed(c).alias(name) for c, name in first],
        money.alias("gross_bookings_usd"),
        *[F.max(c).alias(c) for c in EXPORT_FLAGS],
    )
    per_file = per_transaction.groupBy(*keys).agg(
        *[F.min(name).getField("v").alias(name) for _, name in first],
        F.coalesce(F.sum("gross_bookings_usd"), F.lit(0.0)).alias("gross_bookings_usd"),
        *[F.max(c).alias(c) for c in EXPORT_FLAGS],
    )
    names = [name for _, name in first] + ["gross_bookings_usd", *EXPORT_FLAGS]
    newest = per_file.groupBy("social_id").agg(
        F.max_by(F.struct(*names), F.struct(year, month)).alias("row")
    )
    return newest.select("social_id", "row.*")


def user_grain_summary(users: DataFrame, top: int = 10) -> DataFrame:
    """Long summary: users per type, repeat buyers with a known second destination, and their top destinations."""
    repeaters = users.filter(F.col("tipo_usuario") == MORE_TRIPS)
    row = lambda kind, level, amount: [
        F.lit(kind).alias("medida"), level.alias("valor"), amount.alias("usuarios")
    ]
    types = users.groupBy("tipo_usuario").count().select(*row("tipo_usuario", F.col("tipo_usuario"), F.col("count")))
    known = repeaters.agg(F.count("destino_trip_2").alias("n")).select(
        *row("con_destino_trip_2", F.lit(None).cast("string"), F.col("n"))
    )
    tops = (
        repeaters.filter("destino_trip_2 IS NOT NULL")
        .groupBy("destino_trip_2")
        .count()
        .orderBy(F.desc("count"), "destino_trip_2")
        .limit(top)
        .select(*row("top_destino_trip_2", F.col("destino_trip_2"), F.col("count")))
    )
    return types.unionByName(known).unionByName(tops)


