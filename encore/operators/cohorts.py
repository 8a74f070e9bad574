"""Descriptive cuts and cohorts over the user modelling view.

Reports that cut the same rows in several ways run in one pass: each row is expanded into one record per cut
and the records are combined on the map side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.aggregates import as_col, count_if, first_by, rate
from ..functions.buckets import (
    ACCOUNT_AGE, APP_VISITS, BOOKINGS, REPEAT_SPEED, band, band_below, speed_bucket, trip_count_bucket,
)
from ..functions.media import event_taxonomy
from ..functions.text import first_item
from .targets import HORIZONS

STANDARD_HORIZON = 18
MIN_SEGMENT = 300
OTHERS = "Otros"
NO_REPEAT = "Sin recompra"


def _eligible(horizon: int) -> Column:
    return F.col(f"eligible_{horizon}m")


def _repeated(horizon: int) -> Column:
    return F.col(f"rebuy_{horizon}m")


def _has_trip1() -> Column:
    return F.col("n_transacciones_trip1").isNotNull()


def _base(view: DataFrame, horizon: int) -> DataFrame:
    return view.filter(_eligible(horizon) & _has_trip1())


# --- headline figures -------------------------------------------------------------------------------------------


def kpi_by_horizon(view: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Eligible users, repeat buyers and rate per horizon; one scan for all horizons."""
    counts = view.agg(
        *[count_if(_eligible(h)).alias(f"e{h}") for h in horizons],
        *[count_if(_eligible(h) & _repeated(h)).alias(f"r{h}") for h in horizons],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(h).alias("horizon"), F.col(f"e{h}").alias("n_eligible"), F.col(f"r{h}").alias("n_rebuy"))
                for h in horizons
            ]
        )
    )
    return counts.select(rows.alias("k")).select("k.*").withColumn(
        "rate", F.try_divide(F.col("n_rebuy").cast("double"), F.col("n_eligible").cast("double"))
    )


def kpi_overall(view: DataFrame) -> DataFrame:
    """Users, repeat buyers, and days to the second purchase.

    The exact median holds one counter per distinct day count, so its state is bounded by the window length.
    """
    return view.agg(
        F.count(F.lit(1)).alias("n_total"),
        count_if(F.col("rebuy_ever")).alias("n_rebuy_ever"),
        rate(F.col("rebuy_ever")).alias("rate_ever"),
        F.median(F.when(F.col("rebuy_ever"), F.col("dias_a_recompra"))).alias("mediana_dias_a_recompra"),
        F.avg(F.when(F.col("rebuy_ever"), F.col("dias_a_recompra"))).alias("promedio_dias_a_recompra"),
    )


def contamination_share(view: DataFrame) -> DataFrame:
    """Share of repeat buyers who came back inside the post-trip window."""
    mixed = F.col("flg_contaminado_90d_app")
    return view.filter("rebuy_ever").agg(
        F.count(F.lit(1)).alias("n_rebuyers"),
        count_if(mixed).alias("n_contaminados"),
        F.try_divide(count_if(mixed).cast("double"), F.count(F.lit(1)).cast("double")).alias("pct_contaminados"),
    )


# --- categorical cuts -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cut:
    """A category expression and the rows it applies to."""

    category: Column
    where: Column | None = None


def dominant_channel() -> Column:
    """Channel with most path events; ties go direct, search, metasearch, CRM, other."""
    names = {
        "eventos_directo": "Directo",
        "eventos_sem_seo_kwbrand": "SEM/SEO/KWBrand",
        "eventos_metabuscadores": "Metabuscadores",
        "eventos_crm": "CRM",
    }
    most = F.greatest(*names, "eventos_otros")
    chain = F.when(F.coalesce("eventos_path_total", F.lit(0)) == 0, "Sin path registrado")
    for column, label in names.items():
        chain = chain.when(F.col(column) == most, label)
    return chain.otherwise(OTHERS)


def first_last_same_channel() -> Column:
    same = event_taxonomy("first_click_event_type") == event_taxonomy("last_click_event_type")
    return F.when(same, "Mismo canal (first=last)").otherwise("Canal distinto (multi-touch)")


def _recent(column: str, since: str) -> Column:
    return F.col(column) >= since


def standard_cuts(service_since: str = "2024") -> dict[str, Cut]:
    """The standard report's cuts, by report key."""
    plain = {
        "por_pais": "pais",
        "por_producto": "purchase_type",
        "por_plataforma": "plataforma_trip_1",
        "por_canal": "canales_compra_trip_1",
        "por_cupon": "flg_uso_cupon",
        "por_uso_puntos": "flg_uso_puntos",
        "por_tarjeta_credito": "flg_tarjeta_credito",
        "por_transferencia": "flg_transferencia",
        "por_multi_instrumento": "flg_multi_instrumento_pago",
        "por_app_antes": "flg_app_90d_antes_trip1",
        "por_tiene_vuelo": "tiene_vuelo",
        "por_tipo_viaje": "tipo_viaje",
        "por_rango_edad": "rango_edad_primer_trip",
        "por_income": "income",
        "por_nationality": "nationality",
        "por_pais_residencia": "pais_residencia",
        "por_bucket_anticipacion": "bucket_anticipacion_compra",
        "por_bucket_duracion": "bucket_duracion_viaje",
    }
    has = lambda name: F.col(name).isNotNull()
    served = _recent("cohort_year", service_since)
    media = F.col("cohorte_con_path_medios_valido")
    first, last = "first_click_event_type", "last_click_event_type"
    mood = (
        F.when(F.col("flg_cs_satisfecho") == 1, "Satisfecho")
        .when(F.col("flg_cs_insatisfecho") == 1, "Insatisfecho")
        .otherwise("Neutro/NA")
    )
    home = F.when(F.col("pais") == F.col("pais_residencia"), "Viajó dentro de su país de residencia").otherwise(
        "Viajó fuera de su país de residencia"
    )
    return {
        **{key: Cut(F.col(column)) for key, column in plain.items()},
        "por_flight_class": Cut(F.col("flight_class"), has("flight_class")),
        "por_tier_loyalty": Cut(F.col("tier_al_momento_redencion"), has("tier_al_momento_redencion")),
        "por_customer_service": Cut(F.col("flg_customer_service"), served),
        "por_cs_satisfaccion": Cut(mood, served & (F.col("flg_customer_service") == 1)),
        "por_n_transacciones_trip1": Cut(trip_count_label()),
        "por_pais_vs_residencia_igual": Cut(home, has("pais_residencia")),
        "por_canal_dominante_path": Cut(dominant_channel(), media),
        "por_first_click_canal": Cut(event_taxonomy(first), media & has(first)),
        "por_last_click_canal": Cut(event_taxonomy(last), media & has(last)),
        "por_first_last_mismo_canal": Cut(first_last_same_channel(), media & has(first) & has(last)),
    }


def trip_count_label() -> Column:
    return trip_count_bucket("n_transacciones_trip1", ("1 transacción", "2 transacciones", "3 o más"))


def _expanded(rows: DataFrame, records: Mapping[str, tuple[Mapping[str, Column], Column | None]]) -> DataFrame:
    """One record per row and entry whose condition holds."""
    entries = []
    for key, (fields, where) in records.items():
        record = F.struct(F.lit(key).alias("corte"), *[c.alias(n) for n, c in fields.items()])
        entries.append(record if where is None else F.when(where, record))
    return rows.withColumn("_r", F.explode(F.array(*entries))).filter("_r IS NOT NULL")


def categorical_breakdown(
    view: DataFrame, cuts: Mapping[str, Cut], horizon: int = STANDARD_HORIZON, min_n: int = MIN_SEGMENT
) -> DataFrame:
    """Users, repeats and rate by category of every cut, among eligible users with trip-1 data."""
    records = {key: ({"categoria": cut.category.cast("string")}, cut.where) for key, cut in cuts.items()}
    rows = _base(view, horizon)
    needed = _expanded(rows, records).select("_r.*", _repeated(horizon).alias("again"))
    return (
        needed.groupBy("corte", "categoria")
        .agg(
            F.count(F.lit(1)).alias("n_usuarios"),
            count_if(F.col("again")).alias("n_rebuy"),
            rate(F.col("again")).alias("rate"),
        )
        .filter(F.col("n_usuarios") >= min_n)
        .orderBy("corte", F.desc("rate"))
    )


@dataclass(frozen=True)
class Bins:
    """A measure, its bucket expression and the rows it applies to."""

    value: str
    bucket: Column
    where: Column | None = None


def standard_bins() -> dict[str, Bins]:
    bookings = F.col("gross_bookings_usd")
    last_account, last_visits = ACCOUNT_AGE[-1][2], APP_VISITS[-1][2]
    return {
        "bin_antiguedad_usuario": Bins(
            "antiguedad_usuario_dias_al_trip1",
            F.coalesce(band("antiguedad_usuario_dias_al_trip1", ACCOUNT_AGE), F.lit(last_account)),
        ),
        "bin_visitas_app_antes": Bins(
            "visitas_app_90d_antes_trip1",
            F.coalesce(band("visitas_app_90d_antes_trip1", APP_VISITS), F.lit(last_visits)),
        ),
        "bin_gross_bookings": Bins("gross_bookings_usd", band_below(bookings, BOOKINGS), bookings > 0),
        "bin_n_transacciones_trip1": Bins("n_transacciones_trip1", trip_count_bucket("n_transacciones_trip1")),
    }


def continuous_bins(
    view: DataFrame, bins: Mapping[str, Bins], horizon: int = STANDARD_HORIZON, min_n: int = MIN_SEGMENT
) -> DataFrame:
    """Users, repeats, rate and mean value by bucket of every measure, ordered by the bucket's least value."""
    records = {
        key: ({"bucket": b.bucket, "valor": F.col(b.value).cast("double")}, b.where) for key, b in bins.items()
    }
    rows = _expanded(_base(view, horizon), records).select("_r.*", _repeated(horizon).alias("again"))
    return (
        rows.groupBy("corte", "bucket")
        .agg(
            F.count(F.lit(1)).alias("n_usuarios"),
            count_if(F.col("again")).alias("n_rebuy"),
            rate(F.col("again")).alias("rate"),
            F.avg("valor").alias("avg_valor"),
            F.min("valor").alias("min_valor"),
        )
        .filter(F.col("n_usuarios") >= min_n)
        .orderBy("corte", "min_valor")
        .drop("min_valor")
    )


def distribution_by_target(
    view: DataFrame,
    measures: Mapping[str, Column | None],
    horizon: int = STANDARD_HORIZON,
    accuracy: int = 100_000,
) -> DataFrame:
    """Count, approximate p10-p90 and mean of each measure by target; values are the optional row conditions."""
    records = {}
    for name, where in measures.items():
        given = F.col(name).isNotNull()
        records[name] = ({"valor": F.col(name).cast("double")}, given if where is None else given & where)
    rows = _expanded(_base(view, horizon), records).select("_r.*", _repeated(horizon).alias("rebuy"))
    quantiles = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
    return rows.groupBy(F.col("corte").alias("variable"), "rebuy").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx("valor", p, accuracy).alias(name) for name, p in quantiles.items()],
        F.avg("valor").alias("media"),
    )


STANDARD_PAIRS = {
    "interaccion_app_x_puntos": ("flg_app_90d_antes_trip1", "flg_uso_puntos"),
    "interaccion_app_x_tarjeta": ("flg_app_90d_antes_trip1", "flg_tarjeta_credito"),
    "interaccion_app_x_pais": ("flg_app_90d_antes_trip1", "pais"),
    "interaccion_app_x_producto": ("flg_app_90d_antes_trip1", "purchase_type"),
    "interaccion_app_x_cohort_year": ("flg_app_90d_antes_trip1", "cohort_year"),
}


def two_way_interaction(
    view: DataFrame,
    pairs: Mapping[str, tuple[str, str]] = STANDARD_PAIRS,
    horizon: int = 12,
    min_n: int = MIN_SEGMENT,
) -> DataFrame:
    """Users and rate by pair of values."""
    records = {
        key: ({"a": F.col(a).cast("string"), "b": F.col(b).cast("string")}, None) for key, (a, b) in pairs.items()
    }
    rows = _expanded(_base(view, horizon), records).select("_r.*", _repeated(horizon).alias("again"))
    return (
        rows.groupBy("corte", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"), rate(F.col("again")).alias("rate"))
        .filter(F.col("n") >= min_n)
    )


def event_taxonomy_counts(view: DataFrame) -> DataFrame:
    """Users by channel of the first and the last click."""
    records = {
        name: ({"canal": event_taxonomy(name)}, None) for name in ("first_click_event_type", "last_click_event_type")
    }
    return (
        _expanded(view, records)
        .groupBy(F.col("_r.corte").alias("click"), F.col("_r.canal").alias("canal"))
        .agg(F.count(F.lit(1)).alias("n_usuarios"))
    )


# --- cohorts ----------------------------------------------------------------------------------------------------


def cohort_year_by_horizon(view: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Users, eligible and repeated per cohort year and horizon, from one scan."""
    counts = view.groupBy("cohort_year").agg(
        F.count(F.lit(1)).alias("n"),
        *[count_if(_eligible(h)).alias(f"e{h}") for h in horizons],
        *[count_if(_eligible(h) & _repeated(h)).alias(f"r{h}") for h in horizons],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(h).alias("horizon"), F.col(f"e{h}").alias("n_elig"), F.col(f"r{h}").alias("n_rebuy"))
                for h in horizons
            ]
        )
    )
    return counts.select("cohort_year", "n", rows.alias("k")).select("cohort_year", "n", "k.*").orderBy(
        "horizon", "cohort_year"
    )


def cohort_month(view: DataFrame, horizon: int = STANDARD_HORIZON) -> DataFrame:
    return (
        view.groupBy("cohort_month")
        .agg(
            F.count(F.lit(1)).alias("n"),
            count_if(_eligible(horizon)).alias("n_elig"),
            count_if(_eligible(horizon) & _repeated(horizon)).alias("n_rebuy"),
        )
        .orderBy("cohort_month")
    )


def cohort_country_points(view: DataFrame, horizon: int = STANDARD_HORIZON, min_n: int = 50) -> DataFrame:
    return (
        view.filter(_has_trip1())
        .groupBy(
            "cohort_year",
            "pais",
            F.when(F.col("flg_uso_puntos") == 1, "Con puntos").otherwise("Sin puntos").alias("uso_puntos"),
        )
        .agg(
            F.count(F.lit(1)).alias("n_usuarios"),
            count_if(_eligible(horizon)).alias("n_elegibles"),
            count_if(_eligible(horizon) & _repeated(horizon)).alias("n_rebuy"),
        )
        .filter(F.col("n_usuarios") >= min_n)
        .orderBy("cohort_year", "pais", "uso_puntos")
    )


YEAR_HORIZONS = {2022: 18, 2023: 18, 2024: 12, 2025: 6}


def year_segments(view: DataFrame, year_horizons: Mapping[int, int] = YEAR_HORIZONS, min_n: int = 100) -> DataFrame:
    """Six cuts per cohort year, each year at its own mature horizon."""
    year = F.col("cohort_year").try_cast("int")
    horizon = eligible = again = None
    for y, h in year_horizons.items():
        pick = lambda chain, value: F.when(year == y, value) if chain is None else chain.when(year == y, value)  # noqa: B023,E731
        horizon, eligible, again = (
            pick(horizon, F.lit(h)), pick(eligible, _eligible(h)), pick(again, _repeated(h))
        )
    cuts = {
        "por_producto": F.col("purchase_type"),
        "por_pais": F.col("pais"),
        "por_app_antes": F.col("flg_app_90d_antes_trip1"),
        "por_uso_puntos": F.col("flg_uso_puntos"),
        "por_n_transacciones_trip1": trip_count_label(),
        "por_plataforma": F.col("plataforma_trip_1"),
    }
    records = {key: ({"categoria": c.cast("string")}, None) for key, c in cuts.items()}
    rows = view.filter(year.isin(*year_horizons) & _has_trip1()).filter(eligible)
    return (
        _expanded(rows, records)
        .select("cohort_year", horizon.alias("horizon"), "_r.*", again.alias("again"))
        .groupBy("cohort_year", "horizon", "corte", "categoria")
        .agg(
            F.count(F.lit(1)).alias("n_usuarios"),
            count_if(F.col("again")).alias("n_rebuy"),
            rate(F.col("again")).alias("rate"),
        )
        .filter(F.col("n_usuarios") >= min_n)
        .orderBy("cohort_year", "corte", F.desc("rate"))
    )


# --- top values and the cube ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Top:
    """Keep the ``n`` commonest values of an expression; a null value may take up one of the places."""

    value: Column
    n: int
    where: Column | None = None


def top_values(rows: DataFrame, tops: Mapping[str, Top]) -> DataFrame:
    """The commonest values of each dimension with their rank, ties by value; one pass for all dimensions."""
    records = {key: ({"valor": top.value.cast("string")}, top.where) for key, top in tops.items()}
    counts = (
        _expanded(rows, records)
        .groupBy(F.col("_r.corte").alias("dimension"), F.col("_r.valor").alias("valor"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc_nulls_last("valor"))
    widest = max(top.n for top in tops.values())
    limit = F.create_map(*[F.lit(x) for key, top in tops.items() for x in (key, top.n)])
    return (
        counts.withColumn("puesto", F.row_number().over(order))
        .filter(F.col("puesto") <= widest)
        .filter(F.col("puesto") <= limit[F.col("dimension")])
        .filter("valor IS NOT NULL")
    )


def top_list(tops: DataFrame) -> Column:
    """The top values as one scalar map dimension -> list; its size is the sum of the limits."""
    lists = tops.groupBy("dimension").agg(F.collect_list("valor").alias("valores"))
    return lists.select(F.map_from_entries(F.collect_list(F.struct("dimension", "valores")))).scalar()


def keep_top(value: Column, dimension: str, lists: Column) -> Column:
    listed = F.array_contains(F.try_element_at(lists, F.lit(dimension)), value)
    return F.when(listed, value).otherwise(OTHERS)


def top_n_bucket(rows: DataFrame, column: str, n: int, name: str | None = None) -> DataFrame:
    """The column with everything outside its ``n`` commonest values replaced by 'Otros'."""
    lists = top_list(top_values(rows, {column: Top(F.col(column), n)}))
    return rows.withColumn(name or column, keep_top(F.col(column), column, lists))


def cube_tops(view: DataFrame, transactions: DataFrame) -> DataFrame:
    """Top lists of the cube's dimensions; destinations are ranked by transactions, the rest by users."""
    has = lambda name: F.col(name).isNotNull()
    of_users = {
        "pais": Top(F.col("pais"), 8),
        "producto_t1": Top(F.col("purchase_type"), 6),
        "plataforma": Top(F.col("plataforma_trip_1"), 4),
        "canal": Top(F.col("canales_compra_trip_1"), 5, has("canales_compra_trip_1")),
        "producto_t2": Top(first_item("productos_trip_2"), 7, has("productos_trip_2")),
    }
    of_transactions = {
        f"destino_t{n}": Top(F.col("destino_trip"), 20, (F.col("nro_trip") == n) & has("destino_trip")) for n in (1, 2)
    }
    return top_values(view.filter(_has_trip1()), of_users).unionByName(top_values(transactions, of_transactions))


def trip2_destination(transactions: DataFrame) -> DataFrame:
    """Destination of each user's earliest second-trip transaction that has one."""
    return (
        transactions.filter("nro_trip = 2 AND destino_trip IS NOT NULL")
        .groupBy("social_id")
        .agg(first_by("destino_trip", "reservation_datetime", "transaction_code").alias("destino_t2_iata"))
    )


CUBE_DIMENSIONS = (
    "cohort_year", "cohort_month", "destino_t1", "pais", "producto_t1", "plataforma", "canal", "flg_app",
    "flg_puntos", "n_trx", "tipo_viaje", "producto_t2", "destino_t2",
)
CUBE_HORIZONS = (18, 12, 6)


def cohort_cube(
    view: DataFrame, transactions: DataFrame, min_n: int = 30, tops: DataFrame | None = None
) -> DataFrame:
    """Users, eligible and repeated at three horizons in every cell of thirteen dimensions."""
    lists = top_list(cube_tops(view, transactions) if tops is None else tops)
    top = lambda column, dimension: keep_top(as_col(column), dimension, lists)
    again = F.col("productos_trip_2").isNotNull()
    rows = view.filter(_has_trip1()).join(trip2_destination(transactions), "social_id", "left")
    cells = rows.select(
        "cohort_year",
        F.month("fecha_primer_trip").alias("cohort_month"),
        top("destino_trip", "destino_t1").alias("destino_t1"),
        top("pais", "pais").alias("pais"),
        top("purchase_type", "producto_t1").alias("producto_t1"),
        top("plataforma_trip_1", "plataforma").alias("plataforma"),
        top("canales_compra_trip_1", "canal").alias("canal"),
        F.coalesce(F.col("flg_app_90d_antes_trip1").cast("string"), F.lit("-1")).alias("flg_app"),
        F.coalesce(F.col("flg_uso_puntos").cast("string"), F.lit("-1")).alias("flg_puntos"),
        trip_count_bucket("n_transacciones_trip1").alias("n_trx"),
        F.coalesce("tipo_viaje", F.lit("Sin dato")).alias("tipo_viaje"),
        F.when(again, top(first_item("productos_trip_2"), "producto_t2")).otherwise(NO_REPEAT).alias("producto_t2"),
        F.when(again & F.col("destino_t2_iata").isNotNull(), top("destino_t2_iata", "destino_t2"))
        .otherwise(NO_REPEAT)
        .alias("destino_t2"),
        *[f"{kind}_{h}m" for h in CUBE_HORIZONS for kind in ("eligible", "rebuy")],
    )
    measures = []
    for h in CUBE_HORIZONS:
        measures.append(count_if(_eligible(h)).alias(f"e{h}"))
        measures.append(count_if(_eligible(h) & _repeated(h)).alias(f"r{h}"))
    return (
        cells.groupBy(*CUBE_DIMENSIONS)
        .agg(F.count(F.lit(1)).alias("n"), *measures)
        .filter(F.col("n") >= min_n)
        .orderBy(*CUBE_DIMENSIONS)
    )


def cube_dimension_lists(cube: DataFrame, tops: DataFrame) -> DataFrame:
    """Values of each cube dimension in display order: destinations by volume with the catch-alls last, others
    alphabetically."""
    dims = ("pais", "producto_t1", "plataforma", "canal", "tipo_viaje", "producto_t2", "destino_t1", "destino_t2")
    present = cube.select(
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("valor")) for d in dims])).alias("d")
    ).select("d.*").distinct()
    ranked = present.join(tops.select("dimension", "valor", "puesto"), ["dimension", "valor"], "left")
    by_volume = F.col("dimension").startswith("destino_")
    last = F.when(F.col("valor") == OTHERS, 1_000_001).when(F.col("valor") == NO_REPEAT, 1_000_002)
    key = F.when(by_volume, F.coalesce(last, F.col("puesto"), F.lit(1_000_000))).otherwise(0)
    order = Window.partitionBy("dimension").orderBy(key, "valor")
    return ranked.select("dimension", "valor", F.row_number().over(order).alias("posicion"))


# --- among repeat buyers ----------------------------------------------------------------------------------------


def repeat_speed_buckets(view: DataFrame) -> DataFrame:
    """Users, mean gap and engagement by speed of the second purchase, fastest first."""
    events = {
        "ev_directo": "eventos_directo", "ev_seo": "eventos_sem_seo_kwbrand", "ev_meta": "eventos_metabuscadores",
        "ev_crm": "eventos_crm", "ev_otros": "eventos_otros",
    }
    position = F.lit(len(REPEAT_SPEED))
    for i, (_, _, label) in enumerate(REPEAT_SPEED):
        position = F.when(F.col("speed_bucket") == label, i).otherwise(position)
    return (
        view.filter("rebuy_ever")
        .groupBy(speed_bucket("dias_a_recompra").alias("speed_bucket"))
        .agg(
            F.count(F.lit(1)).alias("n_usuarios"),
            F.avg("dias_a_recompra").alias("avg_dias"),
            F.avg("cantidad_visitas_entre_trips").alias("avg_visitas"),
            F.avg("cantidad_searches_entre_trips").alias("avg_searches"),
            *[F.sum(source).alias(name) for name, source in events.items()],
        )
        .orderBy(position)
    )


def same_product_by_category(view: DataFrame) -> DataFrame:
    return (
        view.filter(F.col("rebuy_ever") & _has_trip1())
        .groupBy(F.col("purchase_type").alias("producto_trip1"))
        .agg(F.count(F.lit(1)).alias("n_rebuyers"), F.sum("flg_mismo_producto_trip_1_2").alias("n_mismo_producto"))
        .orderBy(F.desc("n_rebuyers"), "producto_trip1")
    )


STANDARD_TRANSITIONS = {
    "producto": ("productos_trip_1", "productos_trip_2", 12),
    "canal": ("canales_compra_trip_1", "canales_compra_trip_2", 15),
    "plataforma": ("plataforma_trip_1", "plataforma_trip_2", 15),
}


def transition_top(
    view: DataFrame, transitions: Mapping[str, tuple[str, str, int]] = STANDARD_TRANSITIONS
) -> DataFrame:
    """Commonest first-to-second pairs of each transition, ties by value."""
    records = {key: ({"desde": F.col(a), "hasta": F.col(b)}, None) for key, (a, b, _) in transitions.items()}
    counts = (
        _expanded(view.filter("rebuy_ever"), records)
        .groupBy(F.col("_r.corte").alias("transicion"), F.col("_r.desde").alias("desde"), F.col("_r.hasta").alias("hasta"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("transicion").orderBy(F.desc("n"), "desde", "hasta")
    limit = F.create_map(*[F.lit(x) for key, (_, _, n) in transitions.items() for x in (key, n)])
    widest = max(n for _, _, n in transitions.values())
    return (
        counts.withColumn("puesto", F.row_number().over(order))
        .filter(F.col("puesto") <= widest)
        .filter(F.col("puesto") <= limit[F.col("transicion")])
    )


def trip2_coupon_use(transactions: DataFrame) -> DataFrame:
    """Repeat buyers by coupon flag of their earliest second-trip transaction."""
    return (
        transactions.filter("nro_trip = 2")
        .groupBy("social_id")
        .agg(first_by("flg_uso_cupon", "reservation_datetime", "transaction_code").alias("flg_uso_cupon_trip2"))
        .groupBy("flg_uso_cupon_trip2")
        .agg(F.count(F.lit(1)).alias("n_rebuyers"))
    )


def travel_pairs(view: DataFrame, transactions: DataFrame) -> DataFrame:
    """Destination and check-in of both trips of each repeat buyer who has them all."""
    second = (
        transactions.filter("nro_trip = 2")
        .groupBy("social_id")
        .agg(
            first_by("destino_trip", "reservation_datetime", "transaction_code").alias("destino_trip2"),
            first_by("trip_checkin", "reservation_datetime", "transaction_code").alias("checkin_trip2"),
        )
        .filter("destino_trip2 IS NOT NULL AND checkin_trip2 IS NOT NULL")
    )
    first = view.filter("rebuy_ever AND destino_trip IS NOT NULL AND trip_checkin IS NOT NULL").select(
        "social_id", F.col("destino_trip").alias("destino_trip1"), F.col("trip_checkin").alias("checkin_trip1")
    )
    return first.join(second, "social_id")


def destination_season_loyalty(pairs: DataFrame) -> DataFrame:
    """Shares of repeat buyers with the same destination, travel month and travel quarter."""
    same = lambda f: f("checkin_trip1") == f("checkin_trip2")
    share = lambda c: F.try_divide(count_if(c).cast("double"), F.count(F.lit(1)).cast("double"))
    return pairs.agg(
        F.count(F.lit(1)).alias("n_rebuyers"),
        share(F.col("destino_trip1") == F.col("destino_trip2")).alias("pct_mismo_destino"),
        share(same(F.month)).alias("pct_mismo_mes"),
        share(same(F.quarter)).alias("pct_mismo_trimestre"),
    )


def same_destination_top(pairs: DataFrame, min_n: int = 1000, n: int = 15) -> DataFrame:
    return (
        pairs.groupBy("destino_trip1")
        .agg(
            F.count(F.lit(1)).alias("n_rebuyers"),
            count_if(F.col("destino_trip1") == F.col("destino_trip2")).alias("n_mismo_destino"),
        )
        .filter(F.col("n_rebuyers") >= min_n)
        .orderBy(F.desc("n_rebuyers"), "destino_trip1")
        .limit(n)
    )


def destination_transition(pairs: DataFrame, n: int = 15) -> DataFrame:
    return (
        pairs.groupBy("destino_trip1", "destino_trip2")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "destino_trip1", "destino_trip2")
        .limit(n)
    )


def travel_month_matrix(pairs: DataFrame) -> DataFrame:
    return (
        pairs.groupBy(F.month("checkin_trip1").alias("mes_trip1"), F.month("checkin_trip2").alias("mes_trip2"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("mes_trip1", "mes_trip2")
    )
