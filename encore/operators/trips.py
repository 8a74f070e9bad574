"""First and second trips and the detail rows behind them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.aggregates import latest, text_list


@dataclass(frozen=True)
class Scope:
    """Which purchases count: one brand, one line of business, one status."""

    brand: str
    line_of_business: str = "B2C"
    status: str = "Confirmado"


ONE_TRIP = "1 trip"
MORE_TRIPS = "2 o mas trips"


def _text_ids(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("string") for name in names})


def confirmed_transactions(transactions: DataFrame, scope: Scope) -> DataFrame:
    """One row per transaction and user with the newest platform, channel and trip type."""
    rows = transactions.filter(
        F.col("reservation_year_month").isNotNull()
        & (F.col("brand") == scope.brand)
        & (F.col("line_of_business") == scope.line_of_business)
        & (F.col("transaction_status") == scope.status)
        & F.col("social_id").isNotNull()
        & F.col("transaction_code").isNotNull()
    )
    return (
        _text_ids(rows, "transaction_code", "social_id")
        .groupBy("transaction_code", "social_id")
        .agg(
            F.max("reservation_date").alias("reservation_date"),
            F.max("reservation_datetime").alias("reservation_datetime"),
            *[latest(c, "reservation_datetime").alias(c) for c in ("platform", "parent_channel", "trip_type")],
        )
    )


def _confirmed_trip_rows(trips: DataFrame, scope: Scope) -> DataFrame:
    rows = trips.filter(
        F.col("reservation_year_month").isNotNull()
        & (F.col("trip_status") == scope.status)
        & (F.col("transaction_status") == scope.status)
        & (F.col("brand") == scope.brand)
    )
    return _text_ids(rows, "social_id", "trip_id", "transaction_code")


def trips_base(trips: DataFrame, confirmed: DataFrame, scope: Scope) -> DataFrame:
    """One row per user and trip; a trip is dated by its earliest reservation."""
    rows = _confirmed_trip_rows(trips, scope).filter(
        F.col("social_id").isNotNull() & F.col("trip_id").isNotNull()
    )
    return (
        rows.join(confirmed.select("social_id", "transaction_code"), ["social_id", "transaction_code"], "left_semi")
        .groupBy("social_id", "trip_id")
        .agg(F.min("reservation_datetime").alias("fecha_trip"))
    )


def months_after(when: Column, months: int) -> Column:
    """Calendar months later, clipped to the month's last day."""
    return when + F.make_ym_interval(F.lit(0), F.lit(months))


def first_second_trip(trip_dates: DataFrame, window_months: int = 36) -> DataFrame:
    """One row per user with the first two trips; users whose second trip is later than the window are left out.

    The rank filter lets Spark keep two rows per user before the shuffle, whatever a user's trip count.
    """
    order = Window.partitionBy("social_id").orderBy("fecha_trip", "trip_id")
    ranked = trip_dates.withColumn("orden", F.row_number().over(order)).filter("orden <= 2")
    users = ranked.groupBy("social_id").agg(
        F.max(F.when(F.col("orden") == 1, F.col("trip_id"))).alias("trip_id_1"),
        F.max(F.when(F.col("orden") == 1, F.col("fecha_trip"))).alias("fecha_primer_trip"),
        F.max(F.when(F.col("orden") == 2, F.col("trip_id"))).alias("trip_id_2"),
        F.max(F.when(F.col("orden") == 2, F.col("fecha_trip"))).alias("fecha_segundo_trip"),
    )
    second = F.col("fecha_segundo_trip")
    return users.filter(second.isNull() | (second <= months_after(F.col("fecha_primer_trip"), window_months)))


def trip_detail(users: DataFrame, trips: DataFrame, confirmed: DataFrame, scope: Scope) -> DataFrame:
    """Distinct product rows of trips 1 and 2 with lead time and length in days.

    Users are unpivoted to (user, trip, number), so the join has equality keys only.
    """
    numbered = users.select(
        "social_id",
        "fecha_primer_trip",
        "fecha_segundo_trip",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("nro_trip"), F.col("trip_id_1").alias("trip_id")),
                F.struct(F.lit(2).alias("nro_trip"), F.col("trip_id_2").alias("trip_id")),
            )
        ).alias("trip"),
    ).select("social_id", "fecha_primer_trip", "fecha_segundo_trip", "trip.*").filter("trip_id IS NOT NULL")
    bought = confirmed.select(
        "social_id",
        "transaction_code",
        F.col("trip_type").alias("tipo_viaje"),
        F.col("platform").alias("plataforma_compra"),
        F.col("parent_channel").alias("canal_compra_agrupado"),
    )
    day = lambda name: F.col(name).cast("date")
    rows = (
        _confirmed_trip_rows(trips, scope)
        .join(numbered, ["social_id", "trip_id"])
        .join(bought, ["social_id", "transaction_code"])
    )
    return rows.select(
        "social_id",
        "nro_trip",
        "trip_id",
        "transaction_code",
        "purchase_type",
        "product_type",
        F.col("country_code").alias("pais"),
        "tipo_viaje",
        "plataforma_compra",
        "canal_compra_agrupado",
        F.col("first_origin_id").alias("origen_trip"),
        F.col("first_destination_id").alias("destino_trip"),
        "reservation_date",
        "reservation_datetime",
        F.col("trip_checkin").cast("timestamp_ntz").alias("trip_checkin"),
        F.col("trip_checkout").cast("timestamp_ntz").alias("trip_checkout"),
        F.datediff(day("trip_checkin"), day("reservation_datetime")).alias("dias_anticipacion_compra_checkin"),
        F.datediff(day("trip_checkout"), day("trip_checkin")).alias("duracion_viaje_dias"),
        day("fecha_primer_trip").alias("fecha_primer_trip"),
        day("fecha_segundo_trip").alias("fecha_segundo_trip"),
        F.when(F.col("fecha_segundo_trip").isNull(), ONE_TRIP).otherwise(MORE_TRIPS).alias("tipo_usuario"),
    ).distinct()


def visit_bounds(users: DataFrame) -> DataFrame:
    """One row: the dates between which any repeat buyer's gap can lie."""
    return users.filter("fecha_segundo_trip IS NOT NULL").agg(
        F.min(F.col("fecha_primer_trip").cast("date")).alias("fecha_min"),
        F.max(F.col("fecha_segundo_trip").cast("date")).alias("fecha_max"),
    )


def visits_in_range(visits: DataFrame, bounds: DataFrame, company: str) -> DataFrame:
    """The company's visits between two dates.

    The one-row bounds are fetched so that the fact's partition column meets literals and is pruned.
    """
    limits = bounds.first()
    rows = visits.filter(
        (F.upper(F.trim("company")) == company.upper())
        & F.col("social_id").isNotNull()
        & F.col("visit_id").isNotNull()
    )
    if limits["fecha_min"] is None:
        rows = rows.filter(F.lit(False))
    else:
        rows = rows.filter(F.col("visit_date").between(str(limits["fecha_min"]), str(limits["fecha_max"])))
    return rows.withColumns(
        {
            "social_id": F.col("social_id").cast("string"),
            "start_visit": F.col("start_visit").cast("timestamp_ntz"),
        }
    )


def activity_between_trips(visits: DataFrame, users: DataFrame, company: str, bounds: DataFrame | None = None) -> DataFrame:
    """Distinct visits and summed searches strictly between a user's two trips."""
    repeaters = users.filter("fecha_segundo_trip IS NOT NULL").select(
        "social_id", "fecha_primer_trip", "fecha_segundo_trip"
    )
    seen = visits_in_range(visits, visit_bounds(users) if bounds is None else bounds, company).select(
        "social_id", "visit_id", "start_visit", "count_search"
    )
    searched = F.sum(F.coalesce("count_search", F.lit(0)))
    # Rows of one visit at one time are added up before they move; a heavy user's rows can be split by the join.
    summed = seen.groupBy("social_id", "visit_id", "start_visit").agg(searched.alias("count_search"))
    between = summed.join(repeaters, "social_id").filter(
        (F.col("start_visit") > F.col("fecha_primer_trip")) & (F.col("start_visit") < F.col("fecha_segundo_trip"))
    )
    of_visit = between.groupBy("social_id", "visit_id").agg(F.sum("count_search").alias("count_search"))
    return of_visit.groupBy("social_id").agg(
        F.count(F.lit(1)).alias("cantidad_visitas_entre_trips"),
        F.sum("count_search").alias("cantidad_searches_entre_trips"),
    )


def purchase_lists_per_trip(detail: DataFrame) -> DataFrame:
    """Platforms and channels of each trip as sorted text lists."""
    on = lambda n: F.col("nro_trip") == n
    return detail.groupBy("social_id").agg(
        text_list("plataforma_compra", on(1)).alias("plataforma_trip_1"),
        text_list("plataforma_compra", on(2)).alias("plataforma_trip_2"),
        text_list("canal_compra_agrupado", on(1)).alias("canales_compra_trip_1"),
        text_list("canal_compra_agrupado", on(2)).alias("canales_compra_trip_2"),
    )


def products_per_trip(detail: DataFrame) -> DataFrame:
    """Product lists of both trips and whether they share a product."""
    on = lambda n: F.col("nro_trip") == n
    kinds = lambda n: F.collect_set(F.when(on(n), F.col("product_type")))
    return (
        detail.filter("product_type IS NOT NULL")
        .groupBy("social_id")
        .agg(
            text_list("product_type", on(1)).alias("productos_trip_1"),
            text_list("product_type", on(2)).alias("productos_trip_2"),
            F.arrays_overlap(kinds(1), kinds(2)).cast("int").alias("flg_mismo_producto_trip_1_2"),
        )
    )


def target_transactions(detail: DataFrame, *owner: str) -> DataFrame:
    """Transactions of the kept trips (with their owner, if one is named): the key list for every later source."""
    return detail.filter("transaction_code IS NOT NULL").select("transaction_code", "reservation_date", *owner).distinct()


__all__ = [
    "Scope",
    "confirmed_transactions",
    "trips_base",
    "first_second_trip",
    "trip_detail",
    "visit_bounds",
    "visits_in_range",
    "activity_between_trips",
    "purchase_lists_per_trip",
    "products_per_trip",
    "target_transactions",
    "months_after",
]
