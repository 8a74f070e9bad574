"""Scoring an audience and choosing the next best action."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.aggregates import as_col
from ..functions.ranking import exact_quantiles
from .propensity import CATEGORIES, FEATURES, FLAGS, OTHERS, Booster, Scorer, feature_columns, scorer

# Score thresholds, levers, default actions and cross-sell suggestions.
HIGH, MEDIUM = 0.35, 0.20


@dataclass(frozen=True)
class Lever:
    feature: str
    name: str
    action: str


def levers(programme: str = "el programa de puntos") -> tuple[Lever, ...]:
    return (
        Lever(
            "flg_app_90d_antes_trip1",
            "Activar App",
            "Campaña de descarga y activación de App móvil (push/email con deeplink).",
        ),
        Lever(
            "flg_uso_puntos",
            "Enrollar en Loyalty",
            f"Campaña de bienvenida a {programme} con bono de puntos en primera redención.",
        ),
        Lever(
            "flg_multi_instrumento_pago",
            "Diversificar medios de pago",
            "Oferta de cuotas sin interés o descuento por primer pago con tarjeta de crédito.",
        ),
        Lever(
            "flg_uso_cupon",
            "Activar con cupón",
            "Enviar cupón de descuento personalizado (mayor efectividad en segmentos de bajo score).",
        ),
    )


DEFAULT_ACTIONS = (
    ("Oferta personalizada", "Enviar propuesta de valor personalizada al destino del trip 1."),
    ("Reactivación por email", "Email de reactivación con destinos populares de su perfil."),
)
CROSS_SELL: Mapping[str, str] = {
    "Vuelos": "Hotel",
    "Hoteles": "Vuelos",
    "Carrito": "Paquete completo (vuelo + hotel)",
    "Actividades": "Vuelos",
    "Autos": "Hotel",
    "Traslados": "Vuelos",
    "Asistencia al viajero": "Paquete de viaje",
    "Bundles": "Actividades en destino",
}
DEFAULT_PRODUCT = "Paquete completo"


def load_audience(view: DataFrame, ids: DataFrame | None = None, only_non_repeaters: bool = False) -> DataFrame:
    """Users with trip-1 data, optionally only those never back, optionally only those on an id list."""
    rows = view.filter("n_transacciones_trip1 IS NOT NULL")
    if only_non_repeaters:
        rows = rows.filter(~F.col("rebuy_ever"))
    if ids is not None:
        wanted = ids.select(F.col("social_id").cast("string").alias("social_id"))
        rows = rows.join(wanted, "social_id", "left_semi")
    return rows


def known_levels(rows: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Categories the model has not seen become 'Otros', or null if it has not seen that either."""

    def mapped(c: str) -> Column:
        seen = list(levels.get(c, ()))
        other = F.lit(OTHERS if OTHERS in seen else None).cast("string")
        return F.when(F.col(c).isin(seen), F.col(c)).otherwise(other) if seen else other

    return rows.withColumns({c: mapped(c) for c in CATEGORIES})


def score_features(audience: DataFrame, levels: Mapping[str, Sequence[str]], median_account_age: float) -> DataFrame:
    """Model features of an audience, with the training median and the training levels."""
    return known_levels(feature_columns(audience, median_account_age), levels)


def segment(score: str | Column) -> Column:
    score = as_col(score)
    return F.when(score >= HIGH, "alto").when(score >= MEDIUM, "medio").otherwise("bajo")


def score_and_segment(rows: DataFrame, score: str = "score") -> DataFrame:
    """Score to four places, and the segment of the exact score."""
    return rows.withColumns({"p_rebuy_18m": F.bround(score, 4), "segmento": segment(score)})


def next_best_levers(rows: DataFrame, importance: Mapping[str, float], choices: Sequence[Lever] | None = None) -> DataFrame:
    """The two most important levers a user has not pulled, ties by name from Z to A, with defaults."""
    choices = levers() if choices is None else choices
    open_levers = F.array(
        *[
            F.when(
                F.col(lever.feature) == 0,
                F.struct(
                    F.lit(float(importance.get(lever.feature, 0.0))).alias("weight"),
                    F.lit(lever.name).alias("name"),
                    F.lit(lever.action).alias("action"),
                ),
            )
            for lever in choices
        ]
    )
    ranked = F.sort_array(F.filter(open_levers, lambda x: x.isNotNull()), asc=False)
    columns = {}
    for i, (name, action) in enumerate(DEFAULT_ACTIONS, start=1):
        chosen = F.try_element_at(ranked, F.lit(i))
        columns[f"palanca_{i}"] = F.coalesce(chosen["name"], F.lit(name))
        columns[f"accion_{i}"] = F.coalesce(chosen["action"], F.lit(action))
    return rows.withColumns(columns)


def cross_sell(product: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CROSS_SELL.items() for x in pair])
    return F.coalesce(F.try_element_at(table, as_col(product)), F.lit(DEFAULT_PRODUCT))


AUDIENCE_COLUMNS = (
    "social_id", "pais", "purchase_type_t1", "cohort_year", "rebuy_ever", "p_rebuy_18m", "segmento", "palanca_1",
    "accion_1", "palanca_2", "accion_2", "producto_sugerido",
)


def audience_table(scored: DataFrame, importance: Mapping[str, float], choices: Sequence[Lever] | None = None) -> DataFrame:
    """The twelve-column table handed to campaigns."""
    filled = scored.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in FLAGS})
    rows = next_best_levers(score_and_segment(filled), importance, choices)
    return rows.withColumns(
        {"purchase_type_t1": F.col("purchase_type"), "producto_sugerido": cross_sell("purchase_type")}
    ).select(*AUDIENCE_COLUMNS)


def score_audience(
    view: DataFrame,
    booster: Booster,
    ids: DataFrame | None = None,
    only_non_repeaters: bool = False,
    score: Scorer | None = None,
) -> DataFrame:
    """Audience, features, score and actions in one pass: the bundle's model unless another score is given.

    The audience's own columns travel beside the features under other names, so nothing is joined back.
    """
    audience = load_audience(view, ids, only_non_repeaters)
    own = ("pais", "purchase_type", "cohort_year", "rebuy_ever")
    kept = audience.withColumns({f"_{c}": F.col(c) for c in own})
    features = score_features(kept, booster.levels, booster.median_account_age)
    rows = features.select("social_id", *FEATURES, *[f"_{c}" for c in own])
    scored = (score or scorer(booster.model))(rows)
    return audience_table(
        scored.drop(*own).withColumnsRenamed({f"_{c}": c for c in own}), booster.importance
    )


def segment_summary(table: DataFrame, score: str = "p_rebuy_18m") -> DataFrame:
    """Overall mean and median score, users and mean score per segment, users per first lever."""
    row = lambda kind, level, n, mean, median: [
        F.lit(kind).alias("medida"), level.alias("valor"), n.alias("n"), mean.alias("media"), median.alias("mediana")
    ]
    none = F.lit(None)
    n, mean = F.col("n"), F.col("media")
    grouped = lambda c: table.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("media"))
    median = exact_quantiles(table, score, [0.5]).select("value").scalar()
    overall = table.agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("media")).withColumn("mediana", median)
    return (
        overall.select(*row("general", none.cast("string"), n, mean, F.col("mediana")))
        .unionByName(grouped("segmento").select(*row("segmento", F.col("segmento"), n, mean, none.cast("double"))))
        .unionByName(
            grouped("palanca_1").select(*row("palanca_1", F.col("palanca_1"), n, none.cast("double"), none.cast("double")))
        )
    )
