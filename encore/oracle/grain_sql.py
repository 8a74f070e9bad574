"""Transaction and user grain, targets and lookups."""

from ..functions.places import DESTINATION_KIND_CITIES, REGION_CITIES

MIN_DATE = "1995-03-01"
MARGIN_SINCE = "1996-01-01"
MEDIA_SINCE = "1997-01-01"
HORIZONS = (6, 12, 18, 24, 36)


def early(cols, order, cast=""):
    return ", ".join(
        f"first({c}{cast} ORDER BY {', '.join(order)}, {c}{cast}) FILTER ({c} IS NOT NULL) AS {c}" for c in cols
    )


def late(cols, order):
    down = ", ".join(f"{k} DESC" for k in order)
    return ", ".join(f"first({c} ORDER BY {down}, {c} DESC) FILTER ({c} IS NOT NULL) AS {c}" for c in cols)


def biggest(cols, cast=""):
    return ", ".join(f"max({c}){cast} AS {c}" for c in cols)


def total(cols, cast=""):
    return ", ".join(f"sum({c}){cast} AS {c}" for c in cols)


TX_ORDER = ["reservation_datetime", "trip_id", "product_type"]
TX_TEXT = [
    "social_id", "nro_trip", "trip_id", "purchase_type", "pais", "plataforma_compra", "canal_compra_agrupado",
    "origen_trip", "destino_trip", "flight_class", "product_type", "tipo_viaje", "birth_year", "edad_aprox_primer_trip",
    "rango_edad_primer_trip", "income", "nationality", "pais_residencia", "estado_residencia", "ciudad_residencia",
    "antiguedad_usuario_dias_al_trip1", "geo_ultima_visita_ciudad", "geo_ultima_visita_pais",
    "geo_visita_frecuente_ciudad", "geo_visita_frecuente_pais", "dias_anticipacion_compra_checkin",
    "bucket_anticipacion_compra", "duracion_viaje_dias", "bucket_duracion_viaje", "first_click_event_type",
]
TX_INTS = [
    "flg_uso_cupon", "flg_uso_puntos", "cantidad_pagos", "cantidad_instrumentos_pago", "cantidad_tipos_pago",
    "flg_multi_instrumento_pago", "flg_multi_tipo_pago", "flg_tarjeta_credito", "flg_transferencia",
    "flg_deposito_bancario", "flg_puntos_loyalty_pago", "flg_cupon_pago", "flg_cash", "flg_customer_service",
    "cantidad_interacciones_cs", "cantidad_conversaciones_cs", "flg_cs_satisfecho", "flg_cs_insatisfecho",
    "flg_cs_resuelto", "flg_cs_no_resuelto", "eventos_directo", "eventos_sem_seo_kwbrand", "eventos_metabuscadores",
    "eventos_crm", "eventos_otros", "eventos_path_total",
]
TX_REALS = [
    "puntos_usados", "gb_total_payments", "pct_gb_tarjeta_credito", "pct_gb_transferencia", "pct_gb_deposito_bancario",
    "pct_gb_puntos_loyalty", "pct_gb_cupon", "pct_gb_cash", "avg_agent_empathy_cs", "gross_bookings_usd", "cost_usd",
    "net_revenues_usd", "fee_net_usd",
]
U_ORDER = ["reservation_datetime", "transaction_code", "product_type"]
U_TEXT = [
    "tipo_usuario", "plataforma_trip_1", "plataforma_trip_2", "canales_compra_trip_1", "canales_compra_trip_2",
    "productos_trip_1", "productos_trip_2",
]
U_INTS = [
    "flg_app_90d_antes_trip1", "visitas_app_90d_antes_trip1", "flg_app_entre_trips", "visitas_app_entre_trips",
    "flg_app_90d_post_trip1", "visitas_app_90d_post_trip1", "cantidad_visitas_entre_trips",
    "cantidad_searches_entre_trips", "flg_mismo_producto_trip_1_2",
]
T1_ORDER = ["reservation_datetime", "transaction_code"]
T1_TEXT = [
    "pais", "purchase_type", "product_type", "origen_trip", "destino_trip", "flight_class", "tipo_viaje", "birth_year",
    "edad_aprox_primer_trip", "rango_edad_primer_trip", "income", "nationality", "pais_residencia", "estado_residencia",
    "ciudad_residencia", "antiguedad_usuario_dias_al_trip1", "geo_ultima_visita_ciudad", "geo_ultima_visita_pais",
    "geo_visita_frecuente_ciudad", "geo_visita_frecuente_pais", "trip_checkin", "trip_checkout",
    "dias_anticipacion_compra_checkin", "bucket_anticipacion_compra", "duracion_viaje_dias", "bucket_duracion_viaje",
]
T1_FLAGS = [
    "flg_uso_cupon", "flg_uso_puntos", "flg_tarjeta_credito", "flg_transferencia", "flg_deposito_bancario",
    "flg_puntos_loyalty_pago", "flg_cupon_pago", "flg_cash", "flg_multi_instrumento_pago", "flg_multi_tipo_pago",
    "flg_customer_service", "flg_cs_satisfecho", "flg_cs_insatisfecho", "flg_cs_resuelto", "flg_cs_no_resuelto",
]
T1_SUM_INT = [
    "cantidad_interacciones_cs", "eventos_directo", "eventos_sem_seo_kwbrand", "eventos_metabuscadores", "eventos_crm",
    "eventos_otros", "eventos_path_total",
]
T1_SUM_REAL = [
    "puntos_usados", "gross_bookings_usd", "cost_usd", "margin_variable_usd", "net_revenues_usd", "npv_usd",
    "fee_net_usd", "gb_total_payments",
]
EXPORT_TEXT = [
    "tipo_usuario", "fecha_primer_trip", "fecha_segundo_trip", "pais", "tipo_viaje", "product_type", "purchase_type",
    "destino_trip", "origen_trip", "plataforma_trip_1", "canales_compra_trip_1", "flight_class",
    "rango_edad_primer_trip", "income", "bucket_anticipacion_compra", "bucket_duracion_viaje", "duracion_viaje_dias",
    "dias_anticipacion_compra_checkin", "trip_checkin", "trip_checkout", "productos_trip_1", "destino_trip_2",
    "origen_trip_2", "tipo_viaje_2", "productos_trip_2", "duracion_viaje_dias_2", "dias_anticipacion_compra_2",
    "gross_bookings_usd_2", "flg_uso_cupon_2", "flight_class_2", "plataforma_trip_2", "canales_compra_trip_2",
    "flg_mismo_producto_trip_1_2",
]
EXPORT_FLAGS = [
    "flg_uso_cupon", "flg_tarjeta_credito", "flg_transferencia", "flg_puntos_loyalty_pago",
]


def code_map(cities) -> str:
    return "MAP {" + ", ".join(f"'{c}': '{g}'" for c, g in cities.items()) + "}"


def mapped(column, cities) -> str:
    return f"coalesce({code_map(cities)}[split_part({column}, ' | ', 1)], 'OTRO')"


CTES = {
    "tx_level": f"""
        SELECT transaction_code, min(reservation_date) AS reservation_date_, min(reservation_datetime) AS reservation_datetime_,
            {early(TX_TEXT, TX_ORDER)}, count(DISTINCT product_type) AS n_product_types,
            {early(["trip_checkin", "trip_checkout"], TX_ORDER, "::DATE")},
            {late(["tier_redencion_raw", "tier_al_momento_redencion", "metodos_pago", "last_click_event_type"], TX_ORDER)},
            {biggest(TX_INTS, "::INTEGER")}, {biggest(TX_REALS)},
            max(margin_variable_without_mkt_net_usd) AS margin_variable_usd, max(npv_without_mkt_net_usd) AS npv_usd,
            min(first_click_datetime) AS first_click_datetime, max(last_click_datetime) AS last_click_datetime
        FROM wide WHERE transaction_code IS NOT NULL GROUP BY transaction_code""",
    "tx": """
        SELECT * EXCLUDE (reservation_date_, reservation_datetime_), reservation_date_ AS reservation_date,
            reservation_datetime_ AS reservation_datetime FROM tx_level""",
    "user_level": f"""
        SELECT social_id, min(fecha_primer_trip) AS fecha_primer_trip, min(fecha_segundo_trip) AS fecha_segundo_trip,
            {early(U_TEXT, U_ORDER)}, {biggest(U_INTS, "::INTEGER")},
            max(ultima_visita_app_antes_trip1) AS ultima_visita_app_antes_trip1,
            max(ultima_visita_app_antes_trip2) AS ultima_visita_app_antes_trip2
        FROM wide GROUP BY social_id""",
    "trip1": f"""
        SELECT social_id, count(*) AS n_transacciones_trip1, min(reservation_datetime) AS trip1_primera_transaccion_dt,
            {early(T1_TEXT, T1_ORDER)},
            first(plataforma_compra ORDER BY reservation_datetime, transaction_code) FILTER (plataforma_compra IS NOT NULL) AS plataforma_compra_tx1,
            first(canal_compra_agrupado ORDER BY reservation_datetime, transaction_code) FILTER (canal_compra_agrupado IS NOT NULL) AS canal_compra_agrupado_tx1,
            {late(["tier_al_momento_redencion", "metodos_pago"], T1_ORDER)}, {biggest(T1_FLAGS)},
            {total(T1_SUM_INT, "::BIGINT")}, {total(T1_SUM_REAL)}, avg(avg_agent_empathy_cs) AS avg_agent_empathy_cs,
            min(first_click_datetime) AS first_click_datetime_, max(last_click_datetime) AS last_click_datetime_,
            {early(["first_click_event_type"], ["first_click_datetime"])},
            {late(["last_click_event_type"], ["last_click_datetime"])}
        FROM tx WHERE nro_trip = 1 GROUP BY social_id""",
    "trip1_agg": """
        SELECT * EXCLUDE (first_click_datetime_, last_click_datetime_), first_click_datetime_ AS first_click_datetime,
            last_click_datetime_ AS last_click_datetime FROM trip1""",
    "every_user": """
        SELECT social_id, fecha_primer_trip AS day1, fecha_segundo_trip AS day2, last_day, date_diff('day', day1, day2) AS gap
        FROM user_level, (SELECT max(fecha_primer_trip) AS last_day FROM user_level)""",
    "observed": f"SELECT * FROM every_user WHERE day1 >= DATE '{MIN_DATE}'",
    "horizon_flags": "SELECT social_id, "
    + ", ".join(f"bool_or(seen) FILTER (h = {h}) AS eligible_{h}m, bool_or(back) FILTER (h = {h}) AS rebuy_{h}m" for h in HORIZONS)
    + f"""
        FROM (SELECT social_id, h, day1 <= last_day - to_months(h) AS seen, ifnull(day2 <= day1 + to_months(h), false) AS back
            FROM every_user, (SELECT unnest({list(HORIZONS)})::INTEGER AS h)) GROUP BY social_id""",
    "observed_columns": f"""
        SELECT social_id, day2 IS NOT NULL AS rebuy_ever, gap::INTEGER AS dias_a_recompra,
            date_diff('day', day1, last_day)::INTEGER AS dias_observados_desde_trip1,
            strftime(day1, '%Y') AS cohort_year, strftime(day1, '%Y-%m') AS cohort_month,
            day1 >= DATE '{MARGIN_SINCE}' AS cohorte_con_margin_valido, day1 >= DATE '{MEDIA_SINCE}' AS cohorte_con_path_medios_valido,
            ifnull(gap <= 90, false) AS flg_contaminado_90d_app
        FROM observed""",
    "app_masks": """
        SELECT social_id, if(flg_contaminado_90d_app, NULL, flg_app_90d_post_trip1) AS flg_app_90d_post_trip1_leakfree,
            if(flg_contaminado_90d_app, NULL, visitas_app_90d_post_trip1) AS visitas_app_90d_post_trip1_leakfree,
            if(flg_app_90d_antes_trip1 = 1, date_diff('day', ultima_visita_app_antes_trip1::DATE, fecha_primer_trip)::INTEGER, NULL)
                AS dias_desde_ultima_visita_app_antes_trip1
        FROM user_level JOIN observed_columns USING (social_id)""",
    "first_trip_columns": """
        SELECT * EXCLUDE (trip1_primera_transaccion_dt), flight_class IS NOT NULL AS with_flight FROM trip1_agg""",
    "mv": """
        SELECT * EXCLUDE (plataforma_compra_tx1, canal_compra_agrupado_tx1, with_flight)
            REPLACE (ifnull(plataforma_trip_1, plataforma_compra_tx1) AS plataforma_trip_1,
                ifnull(canales_compra_trip_1, canal_compra_agrupado_tx1) AS canales_compra_trip_1),
            ifnull(contains(plataforma_trip_1, '|'), false) AS flg_multi_plataforma_trip1, ifnull(with_flight, false) AS tiene_vuelo
        FROM observed_columns JOIN horizon_flags USING (social_id) JOIN app_masks USING (social_id) JOIN user_level USING (social_id)
            LEFT JOIN first_trip_columns USING (social_id)""",
    "export_tx": f"""
        SELECT social_id, year(reservation_date) AS anio, month(reservation_date) AS mes, transaction_code,
            max(gross_bookings_usd) AS gb FROM wide WHERE nro_trip = 1 GROUP BY ALL""",
    "user_grain": f"""
        SELECT * EXCLUDE (anio, mes, n, flg_mismo_producto_trip_1_2), flg_mismo_producto_trip_1_2 AS flg_mismo_producto FROM (
            SELECT f.*, coalesce(g.gb, 0) AS gross_bookings_usd, row_number() OVER (PARTITION BY f.social_id ORDER BY f.anio DESC, f.mes DESC) AS n
            FROM (SELECT social_id, year(reservation_date) AS anio, month(reservation_date) AS mes,
                    {early([c for c in EXPORT_TEXT], U_ORDER)}, {biggest(EXPORT_FLAGS)}
                FROM wide WHERE nro_trip = 1 GROUP BY ALL) f
            JOIN (SELECT social_id, anio, mes, sum(gb) AS gb FROM export_tx GROUP BY ALL) g
                ON f.social_id = g.social_id AND f.anio = g.anio AND f.mes = g.mes)
        WHERE n = 1""",
    "knn_users": f"""
        SELECT * EXCLUDE (origen_trip, flight_class, income, gross_bookings_usd),
            coalesce(origen_trip, 'Sin vuelo') AS origen_trip, coalesce(flight_class, 'Sin vuelo') AS flight_class,
            coalesce(income, 'Unknown') AS income, greatest(gross_bookings_usd, 0) AS gross_bookings_usd,
            ln(1 + greatest(gross_bookings_usd, 0)) AS log_gb_usd
        FROM user_grain""",
    "region_users": f"""
        SELECT social_id, tipo_usuario, destino_trip, destino_trip_2, {mapped("destino_trip", REGION_CITIES)} AS region_destino,
            {mapped("destino_trip_2", REGION_CITIES)} AS region_destino_2 FROM user_grain""",
    "kind_users": f"""
        SELECT social_id, tipo_usuario, destino_trip, destino_trip_2, {mapped("destino_trip", DESTINATION_KIND_CITIES)} AS tipo_destino,
            {mapped("destino_trip_2", DESTINATION_KIND_CITIES)} AS tipo_destino_2 FROM user_grain""",
}
