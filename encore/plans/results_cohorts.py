"""Registered results: descriptive cuts and cohorts. Segment minimums are scaled to the sample data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts
from ..oracle import cohorts_sql as sql
from .catalog import result
from .stages import Stages

MIN_N = 5


@result("kpi_by_horizon", "C1", sql.KPI)
def _(s: Stages):
    return cohorts.kpi_by_horizon(s.modeling_view)


@result(
    "kpi_overall",
    "C2",
    """SELECT count(*) AS n_total, count(*) FILTER (rebuy_ever) AS n_rebuy_ever, count(*) FILTER (rebuy_ever)::DOUBLE / count(*) AS rate_ever,
        median(dias_a_recompra) FILTER (rebuy_ever)::DOUBLE AS mediana_dias_a_recompra,
        avg(dias_a_recompra) FILTER (rebuy_ever) AS promedio_dias_a_recompra FROM mv""",
)
def _(s: Stages):
    return cohorts.kpi_overall(s.modeling_view)


@result("categorical_breakdown", "C3", sql.breakdown(sql.CUTS, 18, MIN_N))
def _(s: Stages):
    return cohorts.categorical_breakdown(s.modeling_view, cohorts.standard_cuts(sql.SERVICE_SINCE), min_n=MIN_N)


@result("continuous_bins", "C4", sql.bins(18, MIN_N))
def _(s: Stages):
    return cohorts.continuous_bins(s.modeling_view, cohorts.standard_bins(), min_n=MIN_N)


@result("distribution_by_target", "C5", sql.distribution(18))
def _(s: Stages):
    measures = {"gross_bookings_usd": F.col("gross_bookings_usd") > 0, "visitas_app_90d_antes_trip1": None}
    return cohorts.distribution_by_target(s.modeling_view, measures)


@result("two_way_interaction", "C6", sql.pairs(12, MIN_N))
def _(s: Stages):
    return cohorts.two_way_interaction(s.modeling_view, min_n=MIN_N)


@result(
    "event_taxonomy",
    "C7",
    f"""SELECT 'first_click_event_type' AS click, {sql.taxonomy('first_click_event_type')} AS canal, count(*) AS n_usuarios FROM mv GROUP BY ALL
    UNION ALL SELECT 'last_click_event_type', {sql.taxonomy('last_click_event_type')}, count(*) FROM mv GROUP BY ALL""",
)
def _(s: Stages):
    return cohorts.event_taxonomy_counts(s.modeling_view)


@result("dominant_channel", "C8", f"SELECT social_id, {sql.DOMINANT} AS canal_dominante FROM mv")
def _(s: Stages):
    return s.modeling_view.select("social_id", cohorts.dominant_channel().alias("canal_dominante"))


@result("first_last_same_channel", "C9", f"SELECT social_id, {sql.SAME} AS recorrido FROM mv")
def _(s: Stages):
    return s.modeling_view.select("social_id", cohorts.first_last_same_channel().alias("recorrido"))


@result("cohort_year_by_horizon", "C10", sql.YEARS)
def _(s: Stages):
    return cohorts.cohort_year_by_horizon(s.modeling_view)


@result(
    "cohort_month",
    "C11",
    """SELECT cohort_month, count(*) AS n, count(*) FILTER (eligible_18m) AS n_elig,
        count(*) FILTER (eligible_18m AND rebuy_18m) AS n_rebuy FROM mv GROUP BY ALL""",
)
def _(s: Stages):
    return cohorts.cohort_month(s.modeling_view)


@result(
    "cohort_country_points",
    "C12",
    f"""SELECT cohort_year, pais, CASE WHEN flg_uso_puntos = 1 THEN 'Con puntos' ELSE 'Sin puntos' END AS uso_puntos,
        count(*) AS n_usuarios, count(*) FILTER (eligible_18m) AS n_elegibles, count(*) FILTER (eligible_18m AND rebuy_18m) AS n_rebuy
    FROM mv WHERE n_transacciones_trip1 IS NOT NULL GROUP BY ALL HAVING count(*) >= {MIN_N}""",
)
def _(s: Stages):
    return cohorts.cohort_country_points(s.modeling_view, min_n=MIN_N)


@result("year_segments", "C13", sql.year_segments(MIN_N))
def _(s: Stages):
    return cohorts.year_segments(s.modeling_view, sql.YEAR_HORIZONS, min_n=MIN_N)


@result(
    "top_n_bucket",
    "C14",
    """SELECT social_id, destino_trip, CASE WHEN destino_trip IN (SELECT destino_trip FROM (
            SELECT destino_trip, count(*) AS n FROM mv GROUP BY ALL ORDER BY n DESC, destino_trip NULLS LAST LIMIT 8)
        WHERE destino_trip IS NOT NULL) THEN destino_trip ELSE 'Otros' END AS destino FROM mv""",
)
def _(s: Stages):
    rows = s.modeling_view.select("social_id", "destino_trip")
    return cohorts.top_n_bucket(rows, "destino_trip", 8, "destino")


@result("cube_top_values", "C14", "SELECT * FROM cube_tops")
def _(s: Stages):
    return cohorts.cube_tops(s.modeling_view, s.tx_level)


@result("cohort_cube", "C15", "SELECT * FROM cube WHERE n >= 1")
def _(s: Stages):
    return cohorts.cohort_cube(s.modeling_view, s.tx_level, min_n=1)


@result(
    "cube_dimension_lists",
    "C16",
    """SELECT dimension, valor, row_number() OVER (PARTITION BY dimension ORDER BY k, valor)::INTEGER AS posicion FROM (
        SELECT c.dimension, c.valor, CASE WHEN NOT starts_with(c.dimension, 'destino_') THEN 0 WHEN c.valor = 'Otros' THEN 9998
            WHEN c.valor = 'Sin recompra' THEN 9999 ELSE t.puesto END AS k
        FROM cube_values c LEFT JOIN cube_tops t ON c.dimension = t.dimension AND c.valor = t.valor)""",
)
def _(s: Stages):
    tops = cohorts.cube_tops(s.modeling_view, s.tx_level)
    return cohorts.cube_dimension_lists(cohorts.cohort_cube(s.modeling_view, s.tx_level, min_n=1, tops=tops), tops)


@result(
    "contamination_share",
    "C17",
    """SELECT count(*) AS n_rebuyers, count(*) FILTER (flg_contaminado_90d_app) AS n_contaminados,
        count(*) FILTER (flg_contaminado_90d_app)::DOUBLE / count(*) AS pct_contaminados FROM mv WHERE rebuy_ever""",
)
def _(s: Stages):
    return cohorts.contamination_share(s.modeling_view)


@result(
    "repeat_speed_buckets",
    "C18",
    """SELECT CASE WHEN dias_a_recompra <= 7 THEN '0-7d' WHEN dias_a_recompra <= 30 THEN '8-30d' WHEN dias_a_recompra <= 90 THEN '31-90d'
            WHEN dias_a_recompra <= 180 THEN '91-180d' WHEN dias_a_recompra <= 365 THEN '181-365d' ELSE '>365d' END AS speed_bucket,
        count(*) AS n_usuarios, avg(dias_a_recompra) AS avg_dias, avg(cantidad_visitas_entre_trips) AS avg_visitas,
        avg(cantidad_searches_entre_trips) AS avg_searches, sum(eventos_directo)::BIGINT AS ev_directo,
        sum(eventos_sem_seo_kwbrand)::BIGINT AS ev_seo, sum(eventos_metabuscadores)::BIGINT AS ev_meta,
        sum(eventos_crm)::BIGINT AS ev_crm, sum(eventos_otros)::BIGINT AS ev_otros
    FROM mv WHERE rebuy_ever GROUP BY 1""",
)
def _(s: Stages):
    return cohorts.repeat_speed_buckets(s.modeling_view)


@result(
    "same_product_by_category",
    "C19",
    """SELECT purchase_type AS producto_trip1, count(*) AS n_rebuyers, sum(flg_mismo_producto_trip_1_2)::BIGINT AS n_mismo_producto
    FROM mv WHERE rebuy_ever AND n_transacciones_trip1 IS NOT NULL GROUP BY 1""",
)
def _(s: Stages):
    return cohorts.same_product_by_category(s.modeling_view)


@result(
    "transition_top",
    "C20",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{k}' AS transicion, {a} AS desde, {b} AS hasta, count(*) AS n,
            row_number() OVER (ORDER BY count(*) DESC, {a} NULLS FIRST, {b} NULLS FIRST)::INTEGER AS puesto
        FROM mv WHERE rebuy_ever GROUP BY 2, 3) WHERE puesto <= {n}"""
        for k, (a, b, n) in cohorts.STANDARD_TRANSITIONS.items()
    ),
)
def _(s: Stages):
    return cohorts.transition_top(s.modeling_view)


@result(
    "trip2_coupon_use",
    "C21",
    """SELECT c AS flg_uso_cupon_trip2, count(*) AS n_rebuyers FROM (
        SELECT social_id, first(flg_uso_cupon ORDER BY reservation_datetime, transaction_code) AS c FROM tx WHERE nro_trip = 2 GROUP BY social_id)
    GROUP BY 1""",
)
def _(s: Stages):
    return cohorts.trip2_coupon_use(s.tx_level)


@result(
    "destination_season_loyalty",
    "C22",
    """SELECT count(*) AS n_rebuyers, count(*) FILTER (destino_trip1 = destino_trip2)::DOUBLE / count(*) AS pct_mismo_destino,
        count(*) FILTER (month(checkin_trip1) = month(checkin_trip2))::DOUBLE / count(*) AS pct_mismo_mes,
        count(*) FILTER (ceil(month(checkin_trip1) / 3.0) = ceil(month(checkin_trip2) / 3.0))::DOUBLE / count(*) AS pct_mismo_trimestre
    FROM travel_pairs""",
)
def _(s: Stages):
    return cohorts.destination_season_loyalty(cohorts.travel_pairs(s.modeling_view, s.tx_level))


@result(
    "same_destination_top",
    "C23",
    f"""SELECT destino_trip1, count(*) AS n_rebuyers, count(*) FILTER (destino_trip1 = destino_trip2) AS n_mismo_destino
    FROM travel_pairs GROUP BY 1 HAVING count(*) >= {MIN_N} ORDER BY 2 DESC, 1 LIMIT 15""",
)
def _(s: Stages):
    return cohorts.same_destination_top(cohorts.travel_pairs(s.modeling_view, s.tx_level), min_n=MIN_N)


@result(
    "destination_transition",
    "C23",
    "SELECT destino_trip1, destino_trip2, count(*) AS n FROM travel_pairs GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15",
)
def _(s: Stages):
    return cohorts.destination_transition(cohorts.travel_pairs(s.modeling_view, s.tx_level))


@result(
    "travel_month_matrix",
    "C24",
    """SELECT month(checkin_trip1)::INTEGER AS mes_trip1, month(checkin_trip2)::INTEGER AS mes_trip2, count(*) AS n
    FROM travel_pairs GROUP BY 1, 2""",
)
def _(s: Stages):
    return cohorts.travel_month_matrix(cohorts.travel_pairs(s.modeling_view, s.tx_level))
