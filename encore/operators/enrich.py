"""Side tables that describe each kept transaction, user or trip.

Facts are aggregated before they meet the key list, so map-side combining shrinks a transaction with very
many rows before any shuffle, and the semi-join then reuses the aggregation's partitioning.

``owner`` names a column of facts and key list that is the same on all rows of a transaction, its user. Grouping and joining by it as
well changes no row, keeps the column, and needs no shuffle where the facts are stored in buckets of users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from ..functions.aggregates import count_if, flag, set_size, text_list
from ..functions.buckets import age_bucket
from ..functions.media import PATH_LABELS, media_group
from ..functions.text import blank_to_null, real
from .trips import visits_in_range

MODEL_ID = 33
# Loyalty tiers, app channels, payment types.
TIERS = ("1- Viajero", "2- Explorador", "3- Global")
APP_CHANNELS = ("iphone-app", "android-app")
CREDIT_CARD = "Tarjeta de Crédito"
PAYMENT_COLUMNS = {
    "tarjeta_credito": CREDIT_CARD,
    "transferencia": "Transferencia",
    "deposito_bancario": "Depósito Bancario",
    "puntos_loyalty": "Puntos Loyalty",
    "cupon": "Cupón",
    "cash": "Cash",
}
PAYMENT_FLAGS = {
    "tarjeta_credito": "flg_tarjeta_credito",
    "transferencia": "flg_transferencia",
    "deposito_bancario": "flg_deposito_bancario",
    "puntos_loyalty": "flg_puntos_loyalty_pago",
    "cupon": "flg_cupon_pago",
    "cash": "flg_cash",
}
MEDIA_COLUMNS = {
    "eventos_directo": "direct",
    "eventos_sem_seo_kwbrand": "search",
    "eventos_metabuscadores": "metasearch",
    "eventos_crm": "crm",
    "eventos_otros": "other",
}
MEASURES = (
    "gross_bookings_usd",
    "cost_usd",
    "margin_variable_without_mkt_net_usd",
    "net_revenues_usd",
    "npv_without_mkt_net_usd",
    "fee_net_usd",
)


def _code(name: str = "transaction_code") -> Column:
    return F.col(name).cast("string").alias("transaction_code")


def _keys(owner: str | None, *more: str) -> list[str]:
    return [*([] if owner is None else [owner]), "transaction_code", *more]


def _named(owner: str | None, name: str = "transaction_code") -> list[Column]:
    return [*([] if owner is None else [F.col(owner).cast("string").alias(owner)]), _code(name)]


def _by_code(df: DataFrame, owner: str | None = None) -> GroupedData:
    return df.groupBy(*_keys(owner))


def _distinct_codes(targets: DataFrame, owner: str | None = None) -> DataFrame:
    return targets.select(*_keys(owner)).distinct()


def _model_events(attribution: DataFrame, model_id: int) -> DataFrame:
    return attribution.filter(
        F.col("reservation_date").isNotNull() & (F.col("model_id").cast("string") == str(model_id))
    ).withColumn("transaction_code", F.col("transaction_id").cast("string"))


def media_path_totals(
    attribution: DataFrame, targets: DataFrame, model_id: int = MODEL_ID, owner: str | None = None
) -> DataFrame:
    """Attribution events of each transaction by media group."""
    group = media_group("event_type")
    counted = (
        _model_events(attribution, model_id)
        .groupBy(*_keys(owner, "reservation_date"))
        .agg(
            *[count_if(group == PATH_LABELS[kind]).alias(name) for name, kind in MEDIA_COLUMNS.items()],
            F.count(F.lit(1)).alias("eventos_path_total"),
        )
        .join(targets, _keys(owner, "reservation_date"), "left_semi")
    )
    names = [*MEDIA_COLUMNS, "eventos_path_total"]
    return _by_code(counted, owner).agg(*[F.sum(name).alias(name) for name in names])


def flight_class_list(
    segments: DataFrame, detail: DataFrame, flight_product: str = "Vuelos", owner: str | None = None
) -> DataFrame:
    """Cabin classes flown in each flight transaction."""
    flights = detail.filter(F.col("product_type") == flight_product).select(*_keys(owner)).distinct()
    rows = segments.filter("reservation_year_month IS NOT NULL").select(
        *_named(owner), F.col("flight_class").cast("string").alias("flight_class")
    )
    return _by_code(rows, owner).agg(text_list("flight_class").alias("flight_class")).join(flights, _keys(owner), "left_semi")


def coupon_use(discounts: DataFrame, targets: DataFrame, owner: str | None = None) -> DataFrame:
    """1 where any discount row carries a coupon code or a coupon use."""
    filled = lambda name: blank_to_null(F.col(name).cast("string")).isNotNull()
    per_day = (
        discounts.filter("reservation_year_month IS NOT NULL")
        .groupBy(*_named(owner), "reservation_date")
        .agg(flag(filled("coupon_code") | filled("coupon_use_id")).alias("flg_uso_cupon"))
        .join(targets, _keys(owner, "reservation_date"), "left_semi")
    )
    return _by_code(per_day, owner).agg(F.max("flg_uso_cupon").alias("flg_uso_cupon"))


def economics(transactions: DataFrame, targets: DataFrame, owner: str | None = None) -> DataFrame:
    """Largest value of each money measure."""
    per_day = (
        transactions.filter("reservation_year_month IS NOT NULL")
        .groupBy(*_named(owner), "reservation_date")
        .agg(*[F.max(m).alias(m) for m in MEASURES])
        .join(targets, _keys(owner, "reservation_date"), "left_semi")
    )
    return _by_code(per_day, owner).agg(*[F.max(m).alias(m) for m in MEASURES])


def trip2_features(
    detail: DataFrame, money: DataFrame, coupons: DataFrame, cabins: DataFrame, fan_out: bool = False, owner: str | None = None
) -> DataFrame:
    """What each repeat buyer's second trip looked like.

    Bookings are added once per transaction; ``fan_out=True`` adds them once per product row instead.
    """
    second = detail.filter("nro_trip = 2")
    rows = second.join(coupons, _keys(owner), "left").join(cabins, _keys(owner), "left")
    described = rows.groupBy("social_id").agg(
        text_list("destino_trip").alias("destino_trip_2"),
        text_list("origen_trip").alias("origen_trip_2"),
        text_list("tipo_viaje").alias("tipo_viaje_2"),
        F.max("duracion_viaje_dias").alias("duracion_viaje_dias_2"),
        F.max("dias_anticipacion_compra_checkin").alias("dias_anticipacion_compra_2"),
        F.max(F.coalesce("flg_uso_cupon", F.lit(0))).alias("flg_uso_cupon_2"),
        text_list("flight_class").alias("flight_class_2"),
    )
    paid = second.select("social_id", "transaction_code")
    if not fan_out:
        paid = paid.distinct()
    booked = (
        paid.join(money.select(*_keys(owner), "gross_bookings_usd"), _keys(owner), "left")
        .groupBy("social_id")
        .agg(F.sum(F.coalesce("gross_bookings_usd", F.lit(0.0))).alias("gross_bookings_usd_2"))
    )
    return described.join(booked, "social_id")


def first_last_click(
    attribution: DataFrame, targets: DataFrame, model_id: int = MODEL_ID, owner: str | None = None
) -> DataFrame:
    """Earliest and latest valid click and their event types; equal times are ordered by event id."""
    clicked = F.col("click_date_time").try_cast("timestamp_ntz")
    events = _model_events(attribution, model_id).withColumn("at", clicked).filter("at IS NOT NULL")
    click = F.struct("at", "event_id", "event_type")
    per_day = (
        events.groupBy(*_keys(owner, "reservation_date"))
        .agg(F.min(click).alias("first"), F.max(click).alias("last"))
        .join(targets, _keys(owner, "reservation_date"), "left_semi")
    )
    return (
        _by_code(per_day, owner)
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .select(
            *_keys(owner),
            F.col("first.at").alias("first_click_datetime"),
            F.col("first.event_type").alias("first_click_event_type"),
            F.col("last.at").alias("last_click_datetime"),
            F.col("last.event_type").alias("last_click_event_type"),
        )
    )


def loyalty_redemption(
    redemptions: DataFrame, targets: DataFrame, code: str = "redeemed_transaction_code", owner: str | None = None
) -> DataFrame:
    """Valid redemption rows with points and a normalised tier; several rows per transaction are possible."""
    points = F.coalesce(F.col("puntos_redimidos"), F.lit(0.0))
    tier = F.trim("tier")
    named = F.coalesce(*[F.when(tier.startswith(t[:2]), t) for t in TIERS])
    rows = redemptions.filter(
        F.col(code).isNotNull() & (F.col("flg_cancelado") == 0) & (F.col("flg_error") == 0)
    ).select(
        *_named(owner, code),
        points.alias("puntos_usados"),
        F.when(points > 0, 1).otherwise(0).alias("flg_uso_puntos"),
        blank_to_null("tier").alias("tier_redencion_raw"),
        named.alias("tier_al_momento_redencion"),
    )
    return rows.join(_distinct_codes(targets, owner), _keys(owner), "left_semi")


def loyalty_per_transaction(redemption_rows: DataFrame, owner: str | None = None) -> DataFrame:
    """Redemptions at transaction grain: points added, best tier kept."""
    return _by_code(redemption_rows, owner).agg(
        F.sum("puntos_usados").alias("puntos_usados"),
        F.max("flg_uso_puntos").alias("flg_uso_puntos"),
        F.max("tier_redencion_raw").alias("tier_redencion_raw"),
        F.max("tier_al_momento_redencion").alias("tier_al_momento_redencion"),
    )


def customer_service(contacts: DataFrame, targets: DataFrame, owner: str | None = None) -> DataFrame:
    """Service contacts of each transaction: counts, satisfaction, resolution, empathy."""
    said = lambda column, value: flag(F.col(column) == value)
    empathy = real("agent_empathy")
    return (
        contacts.filter("transaction_code IS NOT NULL")
        .groupBy(*_named(owner))
        .agg(
            F.lit(1).alias("flg_customer_service"),
            F.count(F.lit(1)).alias("cantidad_interacciones_cs"),
            F.countDistinct("conversation_id").alias("cantidad_conversaciones_cs"),
            said("nps", "Satisfecho").alias("flg_cs_satisfecho"),
            said("nps", "Neutro").alias("flg_cs_neutro"),
            said("nps", "Insatisfecho").alias("flg_cs_insatisfecho"),
            said("nps", "NA").alias("flg_cs_nps_na"),
            said("resolution", "Si").alias("flg_cs_resuelto"),
            said("resolution", "No").alias("flg_cs_no_resuelto"),
            F.avg(empathy).alias("avg_agent_empathy_cs"),
            F.min(empathy).alias("min_agent_empathy_cs"),
            F.max(empathy).alias("max_agent_empathy_cs"),
        )
        .join(_distinct_codes(targets, owner), _keys(owner), "left_semi")
    )


def app_visit_bounds(users: DataFrame, pre_days: int = 90, post_days: int = 90) -> DataFrame:
    last = F.coalesce("fecha_segundo_trip", "fecha_primer_trip").cast("date")
    return users.agg(
        F.date_sub(F.min(F.col("fecha_primer_trip").cast("date")), pre_days).alias("fecha_min"),
        F.date_add(F.max(last), post_days).alias("fecha_max"),
    )


def _app_rows(visits: DataFrame, users: DataFrame, company: str, pre_days: int, post_days: int) -> DataFrame:
    bounds = app_visit_bounds(users, pre_days, post_days)
    return (
        visits_in_range(visits, bounds, company)
        .filter(F.col("main_channel").isin(*APP_CHANNELS))
        .select("social_id", "visit_id", F.col("start_visit").alias("visit_datetime"))
    )


def app_visits(
    visits: DataFrame, users: DataFrame, company: str, pre_days: int = 90, post_days: int = 90
) -> DataFrame:
    """App visits of the kept users inside the padded global date range."""
    return _app_rows(visits, users, company, pre_days, post_days).join(users.select("social_id"), "social_id")


def app_behaviour(
    visits: DataFrame, users: DataFrame, company: str, pre_days: int = 90, post_days: int = 90
) -> DataFrame:
    """App use before trip 1, between the trips and after trip 1, for every user."""
    days = lambda n: F.make_dt_interval(F.lit(n))
    first, second, at = F.col("fecha_primer_trip"), F.col("fecha_segundo_trip"), F.col("visit_datetime")
    windows = {
        "90d_antes_trip1": (at >= first - days(pre_days)) & (at < first),
        "entre_trips": (at > first) & (at < second),
        "90d_post_trip1": (at > first) & (at <= first + days(post_days)),
    }
    dates = users.select("social_id", "fecha_primer_trip", "fecha_segundo_trip")
    rows = _app_rows(visits, users, company, pre_days, post_days).distinct().join(dates, "social_id")
    # One row per visit with a mark for each window, then sums: no row is ever copied to count distinct visits.
    of_visit = rows.groupBy("social_id", "visit_id").agg(
        *[flag(inside).alias(f"flg_app_{name}") for name, inside in windows.items()],
        F.max(F.when(at < first, at)).alias("ultima_visita_app_antes_trip1"),
        F.max(F.when(at < second, at)).alias("ultima_visita_app_antes_trip2"),
    )
    seen = of_visit.groupBy("social_id").agg(
        *[F.max(f"flg_app_{name}").alias(f"flg_app_{name}") for name in windows],
        *[F.sum(f"flg_app_{name}").alias(f"visitas_app_{name}") for name in windows],
        F.max("ultima_visita_app_antes_trip1").alias("ultima_visita_app_antes_trip1"),
        F.max("ultima_visita_app_antes_trip2").alias("ultima_visita_app_antes_trip2"),
    )
    counters = [c for w in windows for c in (f"flg_app_{w}", f"visitas_app_{w}")]
    return (
        users.select("social_id")
        .join(seen, "social_id", "left")
        .select(
            "social_id",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counters],
            "ultima_visita_app_antes_trip1",
            "ultima_visita_app_antes_trip2",
        )
    )


def payment_methods(
    payments: DataFrame, instruments: DataFrame, targets: DataFrame, owner: str | None = None
) -> DataFrame:
    """How each transaction was paid: counts, lists, bookings and shares by method. An ``owner`` can only be ``social_id``."""
    known = instruments.filter("payment_type IS NOT NULL").select(
        "payment_user_id", "social_id", "payment_type", "bank", "tier"
    )
    base = (
        payments.filter("reservation_year_month IS NOT NULL AND transaction_code IS NOT NULL")
        .groupBy(_code(), "payment_method_id", "payment_user_id", "social_id")
        .agg(F.sum(F.coalesce("gross_bookings_usd", F.lit(0.0))).alias("paid"))
        .join(_distinct_codes(targets, owner), _keys(owner), "left_semi")
        .join(known, ["payment_user_id", "social_id"], "left")
    )
    kind = F.col("payment_type")
    card = lambda name: (kind == CREDIT_CARD) & blank_to_null(name).isNotNull()
    totals = _by_code(base, owner).agg(
        set_size("payment_method_id").alias("cantidad_pagos"),
        set_size("payment_user_id").alias("cantidad_instrumentos_pago"),
        set_size("payment_type").alias("cantidad_tipos_pago"),
        text_list("payment_type").alias("metodos_pago"),
        text_list("bank", card("bank")).alias("bancos_tarjeta"),
        text_list("tier", card("tier")).alias("tiers_tarjeta"),
        F.sum("paid").alias("gb_total_payments"),
        *[
            F.sum(F.when(kind == label, F.col("paid")).otherwise(0.0)).alias(f"gb_{name}")
            for name, label in PAYMENT_COLUMNS.items()
        ],
        *[flag(kind == label).alias(PAYMENT_FLAGS[name]) for name, label in PAYMENT_COLUMNS.items()],
    )
    many = lambda name: (F.col(name) > 1).cast("int")
    return totals.select(
        *_keys(owner),
        "cantidad_pagos",
        "cantidad_instrumentos_pago",
        "cantidad_tipos_pago",
        many("cantidad_instrumentos_pago").alias("flg_multi_instrumento_pago"),
        many("cantidad_tipos_pago").alias("flg_multi_tipo_pago"),
        "metodos_pago",
        "bancos_tarjeta",
        "tiers_tarjeta",
        "gb_total_payments",
        *[f"gb_{name}" for name in PAYMENT_COLUMNS],
        *[
            F.try_divide(F.col(f"gb_{name}"), F.col("gb_total_payments")).alias(f"pct_gb_{name}")
            for name in PAYMENT_COLUMNS
        ],
        *PAYMENT_FLAGS.values(),
    )


PROFILE_TEXT = {
    "income": "income",
    "nationality": "nationality",
    "country_code": "pais_residencia",
    "state_code": "estado_residencia_codigo",
    "state_name": "estado_residencia",
    "city_id": "ciudad_residencia_id",
    "city_code": "ciudad_residencia_codigo",
    "city_name": "ciudad_residencia",
    "last_visit_geolocation_city_code": "geo_ultima_visita_ciudad",
    "last_visit_geolocation_country_code": "geo_ultima_visita_pais",
    "frequent_visit_geolocation_city_code": "geo_visita_frecuente_ciudad",
    "frequent_visit_geolocation_country_code": "geo_visita_frecuente_pais",
    "last_transaction_geolocation_city_code": "geo_ultima_transaccion_ciudad",
    "last_transaction_geolocation_country_code": "geo_ultima_transaccion_pais",
}


def user_profile(profiles: DataFrame, users: DataFrame, company: str) -> DataFrame:
    """Newest profile of each user with the age and account age at trip 1.

    Snapshots taken at the same time are ordered by their remaining columns, so the choice is repeatable.
    """
    fields = ["creation_date", "birth_year", *PROFILE_TEXT]
    newest = (
        profiles.filter(
            (F.col("creation_date") >= F.lit("1900-01-01").cast("date"))
            & (F.col("company") == company)
            & F.col("social_id").isNotNull()
        )
        .groupBy(F.col("social_id").cast("string").alias("social_id"))
        .agg(F.max(F.struct("audit_datetime", *fields)).alias("p"))
        .select("social_id", *[F.col(f"p.{f}").alias(f"u_{f}") for f in fields])
    )
    day = F.col("fecha_primer_trip").cast("date")
    age = F.year(day) - F.col("u_birth_year")
    created = F.col("u_creation_date")
    return users.select("social_id", "fecha_primer_trip").join(newest, "social_id", "left").select(
        "social_id",
        created.alias("fecha_creacion_usuario"),
        F.col("u_birth_year").alias("birth_year"),
        F.when(age.between(0, 110), age).alias("edad_aprox_primer_trip"),
        age_bucket(age).alias("rango_edad_primer_trip"),
        *[blank_to_null(f"u_{source}").alias(name) for source, name in PROFILE_TEXT.items()],
        F.when(day >= created, F.datediff(day, created)).alias("antiguedad_usuario_dias_al_trip1"),
    )


PASSENGERS = {
    "adults_quantity": "adultos",
    "childs_quantity": "ninos",
    "infants_quantity": "infantes",
    "total_passengers_quantity": "cantidad_pasajeros",
}


def passengers(products: DataFrame, detail: DataFrame, owner: str | None = None) -> DataFrame:
    """Largest passenger counts per transaction and product."""
    kept = detail.filter("product_type IS NOT NULL").select(*_keys(owner, "product_type")).distinct()
    return (
        products.filter("reservation_year_month IS NOT NULL")
        .groupBy(*_named(owner), "product_type")
        .agg(*[F.max(source).alias(name) for source, name in PASSENGERS.items()])
        .join(kept, _keys(owner, "product_type"), "left_semi")
    )


def traveller_type(detail: DataFrame, passenger_rows: DataFrame, owner: str | None = None) -> DataFrame:
    """Passengers of a whole trip and who travelled."""
    per_trip = (
        detail.select("social_id", "trip_id", "transaction_code", "product_type")
        .join(passenger_rows, _keys(owner, "product_type"), "left")
        .groupBy("social_id", "trip_id")
        .agg(
            F.max("adultos").alias("adultos_viaje"),
            F.max("ninos").alias("ninos_viaje"),
            F.max("infantes").alias("infantes_viaje"),
            F.max("cantidad_pasajeros").alias("cantidad_pasajeros_viaje"),
        )
    )
    minors = (F.coalesce("ninos_viaje", F.lit(0)) > 0) | (F.coalesce("infantes_viaje", F.lit(0)) > 0)
    return per_trip.withColumn(
        "tipo_viajero",
        F.when(minors, "Familia")
        .when(F.col("adultos_viaje") == 1, "Solo")
        .when(F.col("adultos_viaje") >= 2, "Pareja/Amigos")
        .otherwise("Sin dato"),
    )
