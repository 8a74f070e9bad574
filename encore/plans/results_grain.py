"""Registered results: coarser grains, targets, lookups."""

from __future__ import annotations

from ..operators import grain, lookups, targets
from ..oracle.grain_sql import MARGIN_SINCE, MEDIA_SINCE
from ..functions import ranking
from .catalog import result
from .stages import Stages


@result("user_grain_latest_file", "D28", "SELECT * FROM user_grain")
def _(s: Stages):
    return grain.user_grain_latest_file(s.monthly_rows)


@result("tx_level", "D29", "SELECT * FROM tx")
def _(s: Stages):
    return grain.tx_level(s.wide)


@result("user_level", "D30", "SELECT * FROM user_level")
def _(s: Stages):
    return grain.user_level(s.wide)


@result("trip1_agg", "D31", "SELECT * FROM trip1_agg")
def _(s: Stages):
    return grain.trip1_agg(s.tx_level)


@result(
    "horizon_targets",
    "D32",
    """SELECT social_id, fecha_primer_trip, fecha_segundo_trip, h.* EXCLUDE (social_id)
    FROM user_level JOIN horizon_flags h USING (social_id)""",
)
def _(s: Stages):
    return targets.horizon_targets(s.user_level)


@result("modeling_view", "D33", "SELECT * FROM mv")
def _(s: Stages):
    return s.build_modeling_view()


@result(
    "contamination_mask",
    "D34",
    """SELECT social_id, flg_app_90d_post_trip1, visitas_app_90d_post_trip1,
        (fecha_segundo_trip IS NOT NULL AND date_diff('day', fecha_primer_trip, fecha_segundo_trip) <= 90) AS flg_contaminado_90d_app,
        CASE WHEN fecha_segundo_trip IS NULL OR date_diff('day', fecha_primer_trip, fecha_segundo_trip) > 90 THEN flg_app_90d_post_trip1 END AS flg_app_90d_post_trip1_leakfree,
        CASE WHEN fecha_segundo_trip IS NULL OR date_diff('day', fecha_primer_trip, fecha_segundo_trip) > 90 THEN visitas_app_90d_post_trip1 END AS visitas_app_90d_post_trip1_leakfree
    FROM user_level""",
)
def _(s: Stages):
    return targets.contamination_mask(s.user_level)


@result(
    "coverage_validity_flags",
    "D35",
    f"""SELECT social_id, fecha_primer_trip, fecha_primer_trip >= DATE '{MARGIN_SINCE}' AS cohorte_con_margin_valido,
        fecha_primer_trip >= DATE '{MEDIA_SINCE}' AS cohorte_con_path_medios_valido FROM user_level""",
)
def _(s: Stages):
    return targets.coverage_validity_flags(s.user_level, MARGIN_SINCE, MEDIA_SINCE)


@result("seeded_sample", "D36", "SELECT * FROM mv ORDER BY md5('42:' || social_id), social_id LIMIT 500")
def _(s: Stages):
    return ranking.seeded_sample(s.modeling_view, 500, "social_id", seed=42)


_GROUP_SQL = "CASE " + " ".join(
    f"WHEN variable IN ({', '.join(repr(n) for n in names)}) THEN '{group}'"
    for group, names in targets.LEAKAGE_GROUPS.items()
) + " WHEN starts_with(variable, 'rebuy_') OR starts_with(variable, 'eligible_') THEN 'C' END"


@result(
    "leakage_guard",
    "D37",
    f"""SELECT variable, n_con_dato, grupo, coalesce(grupo = 'A', false) AS usable FROM (
        SELECT variable, n_con_dato, {_GROUP_SQL} AS grupo
        FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM mv) ON COLUMNS(*) INTO NAME variable VALUE n_con_dato))""",
)
def _(s: Stages):
    return targets.leakage_report(s.modeling_view)


@result("impute_and_log", "D38", "SELECT * FROM knn_users")
def _(s: Stages):
    return lookups.impute_and_log(s.user_grain)


@result("region_lookup", "D39", "SELECT * FROM region_users")
def _(s: Stages):
    return lookups.region_lookup(s.user_grain)


@result(
    "region_report",
    "D39",
    """SELECT 'cobertura' AS reporte, unnest(['usuarios', 'region_destino', 'region_destino_2']) AS valor,
        unnest([count(*), count(*) FILTER (region_destino <> 'OTRO'), count(*) FILTER (region_destino_2 <> 'OTRO')]) AS n FROM region_users
    UNION ALL SELECT * FROM (SELECT 'top_region_destino', region_destino, count(*) AS n FROM region_users GROUP BY ALL ORDER BY n DESC, 2 LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'top_region_destino_2', region_destino_2, count(*) AS n FROM region_users
        WHERE tipo_usuario = '2 o mas trips' GROUP BY ALL ORDER BY n DESC, 2 LIMIT 10)""",
)
def _(s: Stages):
    return lookups.region_report(s.user_grain)


@result("destination_type_lookup", "D40", "SELECT * FROM kind_users")
def _(s: Stages):
    return lookups.destination_type_lookup(s.user_grain)


@result(
    "destination_type_report",
    "D40",
    """SELECT 'tipo_destino' AS reporte, tipo_destino AS valor, count(*) AS n FROM kind_users GROUP BY ALL
    UNION ALL SELECT 'tipo_destino_2', tipo_destino_2, count(*) FROM kind_users GROUP BY ALL
    UNION ALL SELECT * FROM (SELECT 'sin_mapear', destino_trip, count(*) AS n FROM kind_users
        WHERE tipo_destino = 'OTRO' AND destino_trip IS NOT NULL GROUP BY ALL ORDER BY n DESC, 2 LIMIT 20)""",
)
def _(s: Stages):
    return lookups.destination_type_report(s.user_grain)


@result(
    "user_grain_summary",
    "D41",
    """SELECT 'tipo_usuario' AS medida, tipo_usuario AS valor, count(*) AS usuarios FROM user_grain GROUP BY ALL
    UNION ALL SELECT 'con_destino_trip_2', NULL, count(destino_trip_2) FROM user_grain WHERE tipo_usuario = '2 o mas trips'
    UNION ALL SELECT * FROM (SELECT 'top_destino_trip_2', destino_trip_2, count(*) AS n FROM user_grain
        WHERE tipo_usuario = '2 o mas trips' AND destino_trip_2 IS NOT NULL GROUP BY ALL ORDER BY n DESC, 2 LIMIT 10)""",
)
def _(s: Stages):
    return grain.user_grain_summary(s.user_grain)
