"""Registered results: building the wide table."""

from __future__ import annotations

from ..operators import enrich, trips, wide
from .catalog import result
from .stages import Stages


@result("confirmed_transactions", "D1", "SELECT * FROM confirmed")
def _(s: Stages):
    return trips.confirmed_transactions(s.facts.transactions, s.scope)


@result("trips_base", "D2", "SELECT * FROM trips_base")
def _(s: Stages):
    return trips.trips_base(s.facts.trips, s.confirmed, s.scope)


@result("first_second_trip", "D3", "SELECT * FROM users")
def _(s: Stages):
    return trips.first_second_trip(trips.trips_base(s.facts.trips, s.confirmed, s.scope))


@result("trip_detail", "D4", "SELECT * FROM detail")
def _(s: Stages):
    return trips.trip_detail(s.users, s.facts.trips, s.confirmed, s.scope)


@result("visit_bounds", "D5", "SELECT * FROM bounds")
def _(s: Stages):
    return trips.visit_bounds(s.users)


@result("activity_between_trips", "D6", "SELECT * FROM activity")
def _(s: Stages):
    return trips.activity_between_trips(s.src.visits, s.users, s.src.company)


@result("purchase_lists_per_trip", "D7", "SELECT * FROM purchase_lists")
def _(s: Stages):
    return trips.purchase_lists_per_trip(s.detail)


@result("products_per_trip", "D8", "SELECT * FROM products")
def _(s: Stages):
    return trips.products_per_trip(s.detail)


@result("target_transactions", "D9", "SELECT * FROM targets")
def _(s: Stages):
    return s.targets


@result("media_path_totals", "D10", "SELECT * FROM media_path")
def _(s: Stages):
    return s.by_transaction(s.media_path)


@result("flight_class_list", "D11", "SELECT * FROM cabins")
def _(s: Stages):
    return s.by_transaction(s.cabins)


@result("coupon_use", "D12", "SELECT * FROM coupons")
def _(s: Stages):
    return s.by_transaction(s.coupons)


@result("economics", "D13", "SELECT * FROM economics")
def _(s: Stages):
    return s.by_transaction(s.economics)


@result("trip2_features", "D14", "SELECT * FROM trip2")
def _(s: Stages):
    return enrich.trip2_features(s.detail, s.economics, s.coupons, s.cabins, owner=s.owner)


@result("first_last_click", "D15", "SELECT * FROM clicks")
def _(s: Stages):
    return s.by_transaction(s.clicks)


@result("loyalty_redemption", "D16", "SELECT * FROM redemption_rows")
def _(s: Stages):
    return s.by_transaction(s.loyalty)


@result("customer_service", "D17", "SELECT * FROM service")
def _(s: Stages):
    return s.by_transaction(s.service)


@result("app_visits", "D18", "SELECT * FROM app_visits")
def _(s: Stages):
    return enrich.app_visits(s.src.visits, s.users, s.src.company)


@result("app_behaviour", "D19", "SELECT * FROM app")
def _(s: Stages):
    return enrich.app_behaviour(s.src.visits, s.users, s.src.company)


@result("payment_methods", "D20", "SELECT * FROM payments")
def _(s: Stages):
    return s.by_transaction(s.payment_methods)


@result("user_profile", "D21", "SELECT * FROM profile")
def _(s: Stages):
    return enrich.user_profile(s.src.profiles, s.users, s.src.company)


@result("passengers", "D22", "SELECT * FROM passengers")
def _(s: Stages):
    return s.by_transaction(s.passengers)


@result("traveller_type", "D23", "SELECT * FROM travellers")
def _(s: Stages):
    return enrich.traveller_type(s.detail, s.passengers, owner=s.owner)


@result("final_wide", "D24", "SELECT * FROM wide")
def _(s: Stages):
    return wide.final_wide(s.detail, s.wide_parts())


@result("lead_and_length_buckets", "D25", "SELECT * FROM bucketed")
def _(s: Stages):
    return wide.lead_and_length_buckets(s.detail)


_CONTROLS = """
    SELECT control, level, measure, amount::BIGINT AS amount FROM (
        SELECT 'pagos' AS control, NULL::VARCHAR AS level, unnest(['filas', 'transacciones']) AS measure,
            unnest([count(*), count(DISTINCT transaction_code)]) AS amount FROM payments
        UNION ALL
        SELECT 'app', NULL, unnest(['filas', 'socials', 'users_app_90d_antes_trip1', 'users_app_entre_trips', 'users_app_90d_post_trip1']),
            unnest([count(*), count(DISTINCT social_id), count(DISTINCT social_id) FILTER (flg_app_90d_antes_trip1 = 1),
                count(DISTINCT social_id) FILTER (flg_app_entre_trips = 1), count(DISTINCT social_id) FILTER (flg_app_90d_post_trip1 = 1)])
        FROM app
        UNION ALL
        SELECT 'perfil', NULL, unnest(['filas', 'socials', 'users_con_edad', 'users_con_income', 'users_con_pais_residencia',
                'users_con_estado_residencia', 'users_con_ciudad_residencia', 'users_con_geo_frecuente']),
            unnest([count(*), count(DISTINCT social_id), count(edad_aprox_primer_trip), count(income), count(pais_residencia),
                count(estado_residencia), count(ciudad_residencia), count(geo_visita_frecuente_ciudad)])
        FROM profile
        UNION ALL
        SELECT 'tipo_viaje', tipo_viaje, unnest(['filas', 'usuarios', 'transacciones']),
            unnest([count(*), count(DISTINCT social_id), count(DISTINCT transaction_code)]) FROM wide GROUP BY tipo_viaje
        UNION ALL
        SELECT 'fechas_viaje', NULL, unnest(['filas', 'con_checkin', 'con_checkout', 'con_anticipacion', 'anticipacion_invalida',
                'con_duracion', 'duracion_invalida']),
            unnest([count(*), count(trip_checkin), count(trip_checkout), count(dias_anticipacion_compra_checkin),
                count(*) FILTER (dias_anticipacion_compra_checkin < 0), count(duracion_viaje_dias),
                count(*) FILTER (duracion_viaje_dias < 0)]) FROM wide
        UNION ALL
        SELECT 'final', NULL, unnest(['filas_final', 'usuarios', 'transacciones']),
            unnest([count(*), count(DISTINCT social_id), count(DISTINCT transaction_code)]) FROM wide)"""


@result("wide_controls", "D26", _CONTROLS)
def _(s: Stages):
    return wide.wide_controls(s.wide, s.payments, s.app, s.profile)


@result(
    "wide_sample",
    "D27",
    """
    SELECT * FROM wide ORDER BY social_id, nro_trip, reservation_datetime, transaction_code, product_type,
        destino_trip NULLS FIRST, origen_trip NULLS FIRST, purchase_type LIMIT 100""",
)
def _(s: Stages):
    return wide.wide_sample(s.wide)
