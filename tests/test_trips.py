import datetime as dt

import pytest
from pyspark.sql import functions as F

from encore.operators import enrich, grain, quality, targets, trips

SCOPE = trips.Scope("House")
T = dt.datetime


def ntz(spark, rows, schema, *stamps):
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


def test_second_trip_window_and_drop_rule(spark):
    first = T(2020, 8, 31, 10)
    rows = []
    for user, second in {
        "edge": T(2023, 8, 31, 10), "late": T(2023, 8, 31, 10, 0, 1), "long": T(2030, 1, 1), "one": None,
    }.items():
        rows.append((user, "t1", first))
        if second:
            rows.append((user, "t2", second))
    rows += [("tie", "b", first), ("tie", "a", first), ("tie", "c", first)]
    got = trips.first_second_trip(ntz(spark, rows, "social_id string, trip_id string, fecha_trip timestamp", "fecha_trip"))
    kept = {r["social_id"]: (r["trip_id_1"], r["trip_id_2"]) for r in got.collect()}
    assert kept == {"edge": ("t1", "t2"), "one": ("t1", None), "tie": ("a", "b")}


def test_month_end_targets(spark):
    day = dt.date
    rows = spark.createDataFrame(
        [
            ("in28", day(2023, 8, 31), day(2024, 2, 28)), ("in29", day(2023, 8, 31), day(2024, 2, 29)),
            ("out", day(2023, 8, 31), day(2024, 3, 1)), ("none", day(2024, 2, 29), None),
        ],
        "social_id string, fecha_primer_trip date, fecha_segundo_trip date",
    )
    got = {r["social_id"]: r for r in targets.horizon_targets(rows, [6]).collect()}
    assert [got[u]["rebuy_6m"] for u in ("in28", "in29", "out", "none")] == [True, True, False, False]
    # The data end on 29 Feb 2024; six months before that is 29 Aug 2023, so nobody was observed long enough.
    assert not any(r["eligible_6m"] for r in got.values())
    later = targets.horizon_targets(rows, [6], as_of="2024-03-01").collect()
    assert {r["social_id"]: r["eligible_6m"] for r in later} == {"in28": True, "in29": True, "out": True, "none": False}
    assert all(r["eligible_6m"] for r in targets.horizon_targets(rows, [6], as_of="2024-08-31").collect())


def test_contamination_edge(spark):
    day = dt.date
    rows = spark.createDataFrame(
        [("d90", day(2024, 1, 1), day(2024, 3, 31), 1, 4), ("d91", day(2024, 1, 1), day(2024, 4, 1), 1, 5), ("no", day(2024, 1, 1), None, 0, 0)],
        "social_id string, fecha_primer_trip date, fecha_segundo_trip date, flg_app_90d_post_trip1 int, visitas_app_90d_post_trip1 int",
    )
    got = {r["social_id"]: (r["flg_contaminado_90d_app"], r["visitas_app_90d_post_trip1_leakfree"]) for r in targets.contamination_mask(rows).collect()}
    assert got == {"d90": (True, None), "d91": (False, 5), "no": (False, 0)}


def test_app_window_ends(spark):
    t1, t2 = T(2024, 3, 1, 12), T(2024, 5, 1, 12)
    users = ntz(spark, [("u", t1, t2), ("quiet", t1, None)], "social_id string, fecha_primer_trip timestamp, fecha_segundo_trip timestamp",
                "fecha_primer_trip", "fecha_segundo_trip")
    days = dt.timedelta(days=90)
    at = {"start": t1 - days, "before": t1 - days - dt.timedelta(seconds=1), "trip1": t1, "end": t1 + days, "trip2": t2, "mid": T(2024, 4, 1)}
    rows = [("u", k, v, v.date().isoformat(), 1, " house ", "iphone-app") for k, v in at.items()]
    rows += [("u", "mid", at["mid"], "2024-04-01", 1, "House", "android-app"), ("u", "web", at["mid"], "2024-04-01", 1, "House", "web")]
    visits = ntz(spark, rows, "social_id string, visit_id string, start_visit timestamp, visit_date string, count_search int, company string, main_channel string", "start_visit")
    got = {r["social_id"]: r for r in enrich.app_behaviour(visits, users, "House").collect()}
    u = got["u"]
    assert u["visitas_app_90d_antes_trip1"] == 1 and u["visitas_app_entre_trips"] == 1
    assert u["visitas_app_90d_post_trip1"] == 3  # mid, trip2, end
    assert u["ultima_visita_app_antes_trip2"] == at["mid"]
    assert got["quiet"]["flg_app_90d_antes_trip1"] == 0 and got["quiet"]["ultima_visita_app_antes_trip1"] is None
    seen = trips.activity_between_trips(visits, users, "House").collect()
    assert [(r["social_id"], r["cantidad_visitas_entre_trips"], r["cantidad_searches_entre_trips"]) for r in seen] == [("u", 2, 3)]


def test_no_repeat_buyers_means_no_activity(spark):
    users = ntz(spark, [("u", T(2024, 1, 1), None)], "social_id string, fecha_primer_trip timestamp, fecha_segundo_trip timestamp",
                "fecha_primer_trip", "fecha_segundo_trip")
    visits = ntz(spark, [("u", "v", T(2024, 1, 2), "2024-01-02", 1, "House", "web")],
                 "social_id string, visit_id string, start_visit timestamp, visit_date string, count_search int, company string, main_channel string", "start_visit")
    assert trips.activity_between_trips(visits, users, "House").count() == 0


def detail(spark):
    stamp = T(2024, 1, 1)
    rows = [
        ("u", 1, "t1", "x", "Vuelos", stamp), ("u", 2, "t2", "y", "Vuelos", stamp), ("u", 2, "t2", "y", "Hoteles", stamp),
        ("solo", 1, "s1", "z", "Autos", stamp),
    ]
    df = ntz(spark, rows, "social_id string, nro_trip int, trip_id string, transaction_code string, product_type string, reservation_datetime timestamp", "reservation_datetime")
    extra = {c: F.lit(None).cast("string") for c in ("destino_trip", "origen_trip", "tipo_viaje", "plataforma_compra", "canal_compra_agrupado")}
    numbers = {c: F.lit(3) for c in ("duracion_viaje_dias", "dias_anticipacion_compra_checkin")}
    return df.withColumns({**extra, **numbers, "reservation_date": F.lit("2024-01-01").cast("date")})


def test_trip2_bookings_count_once_per_transaction(spark):
    rows = detail(spark)
    money = spark.createDataFrame([("y", 100.0), ("x", 5.0)], "transaction_code string, gross_bookings_usd double")
    coupons = spark.createDataFrame([("y", 1)], "transaction_code string, flg_uso_cupon int")
    cabins = spark.createDataFrame([("y", "ECONOMY")], "transaction_code string, flight_class string")
    once = enrich.trip2_features(rows, money, coupons, cabins).first()
    twice = enrich.trip2_features(rows, money, coupons, cabins, fan_out=True).first()
    assert (once["gross_bookings_usd_2"], twice["gross_bookings_usd_2"]) == (100.0, 200.0)
    assert once["destino_trip_2"] is None and once["flg_uso_cupon_2"] == 1


def test_products_of_a_user_without_second_trip(spark):
    got = {r["social_id"]: r for r in trips.products_per_trip(detail(spark)).collect()}
    assert got["solo"]["productos_trip_2"] is None and got["solo"]["flg_mismo_producto_trip_1_2"] == 0
    assert got["u"]["productos_trip_2"] == "Hoteles | Vuelos" and got["u"]["flg_mismo_producto_trip_1_2"] == 1


def test_redemptions_collapse_to_the_transaction(spark):
    targets_ = spark.createDataFrame([("a", dt.date(2024, 1, 1))], "transaction_code string, reservation_date date")
    rows = spark.createDataFrame(
        [("a", 10.0, "1-x", 0, 0), ("a", 5.0, " 3-y", 0, 0), ("a", 99.0, "2-z", 1, 0), ("b", 1.0, "1-x", 0, 0)],
        "redeemed_transaction_code string, puntos_redimidos double, tier string, flg_cancelado int, flg_error int",
    )
    kept = enrich.loyalty_redemption(rows, targets_)
    assert kept.count() == 2
    one = enrich.loyalty_per_transaction(kept).collect()
    assert [(r["transaction_code"], r["puntos_usados"], r["tier_al_momento_redencion"]) for r in one] == [("a", 15.0, "3- Global")]


def test_clicks_ignore_unreadable_times_and_break_ties(spark):
    day = dt.date(2024, 1, 1)
    targets_ = spark.createDataFrame([("a", day)], "transaction_code string, reservation_date date")
    rows = spark.createDataFrame(
        [("a", day, "EMAIL", "2", "2024-01-01 10:00:00", 33), ("a", day, "PUSH", "1", "2024-01-01 10:00:00", 33),
         ("a", day, "SEO_A", "9", "never", 33), ("a", day, "SEM_B", "0", "2023-01-01 10:00:00", 34)],
        "transaction_id string, reservation_date date, event_type string, event_id string, click_date_time string, model_id int",
    )
    got = enrich.first_last_click(rows, targets_).first()
    assert (got["first_click_event_type"], got["last_click_event_type"]) == ("PUSH", "EMAIL")


def test_user_grain_takes_the_newest_file_and_counts_bookings_once(spark):
    base = {c: None for c in grain.EXPORT_COLUMNS}

    def row(month, tx, product, when, money, **more):
        return {**base, "social_id": "u", "nro_trip": 1, "transaction_code": tx, "product_type": product, "reservation_datetime": when,
                "gross_bookings_usd": money, "archivo_anio": 2024, "archivo_mes": month, **more}

    rows = [
        row(1, "a", "Autos", "2024-01-01", 1.0, pais="old"),
        row(2, "b", "Vuelos", "2024-02-02", 10.0, pais=None),
        row(2, "b", "Hoteles", "2024-02-02", 10.0, pais="AR"),
        row(2, "c", "Vuelos", "2024-02-03", 5.0, pais="BR"),
        {**row(3, "d", "Vuelos", "2024-03-03", 9.0), "nro_trip": 2},
    ]
    numbers = {"nro_trip": "int", "gross_bookings_usd": "double", "archivo_anio": "int", "archivo_mes": "int"}
    names = list(dict.fromkeys([*grain.EXPORT_COLUMNS, "archivo_anio", "archivo_mes"]))
    schema = ", ".join(f"{c} {numbers.get(c, 'string')}" for c in names)
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
    got = grain.user_grain_latest_file(df).collect()
    assert len(got) == 1 and got[0]["pais"] == "AR" and got[0]["gross_bookings_usd"] == 15.0
    assert got[0]["product_type"] == "Hoteles"
    assert grain.user_grain_latest_file(df, fan_out=True).first()["gross_bookings_usd"] == 25.0


def test_leakage_guard():
    assert targets.leakage_guard(["pais", "income", "log_gross_bookings"]) == ["pais", "income", "log_gross_bookings"]
    for bad in ("productos_trip_2", "rebuy_18m", "flg_customer_service", "made_up", "flg_app_90d_post_trip1"):
        with pytest.raises(targets.LeakageError, match=bad):
            targets.leakage_guard(["pais", bad])
    assert targets.leakage_guard(["flg_app_90d_post_trip1_leakfree"], allowed=("A", "B"))


def test_constancy_check(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, None), ("b", 2, "z"), (None, 1, "q")], "k string, n int, v string")
    got = {r["variable"]: r["claves_inconsistentes"] for r in quality.constancy_check(rows, "k", ["n", "v"]).collect()}
    assert got == {"n": 0, "v": 1}


def test_null_share_lists_missing_columns(spark):
    rows = spark.createDataFrame([("1 trip", None), ("1 trip", "x"), ("2 o mas trips", "y")], "tipo_usuario string, pais string")
    got = {r["variable"]: (r["existe"], r["pct_nulos_a"], r["pct_nulos_b"]) for r in quality.null_share_by_group(rows, ["pais", "nope"]).collect()}
    assert got == {"pais": (True, 50.0, 0.0), "nope": (False, None, None)}
