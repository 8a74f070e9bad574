"""Confirmed lines stored by user: users, trips and transactions meet without moving, with the same rows as by transaction."""

import pytest

from encore.operators import enrich, trips, wide
from encore.plans.stages import Layout
from encore.sources.retail import RetailSources
from tests.test_layout import FOLDER, exchanges, plain_joins, stages  # noqa: F401

MANY = 1_000_000


@pytest.fixture(scope="module")
def dealt(spark):
    return stages(spark, Layout(buckets=4))


def test_trips_and_sides_do_not_move(dealt, plain_joins):  # noqa: F811
    s = dealt
    assert s.owner == "social_id"
    assert exchanges(trips.confirmed_transactions(s.facts.transactions, s.scope)) == 0
    assert exchanges(trips.first_second_trip(trips.trips_base(s.facts.trips, s.confirmed, s.scope))) == 0
    assert exchanges(trips.trip_detail(s.users, s.facts.trips, s.confirmed, s.scope)) == 0
    for name in ("economics", "coupons", "cabins", "passengers", "media_path", "clicks", "loyalty", "service"):
        assert exchanges(getattr(s, name)) == 0, name
    # Payments wait for their instruments, which come from the customers.
    assert exchanges(s.payment_methods) == 1
    assert exchanges(wide.transaction_side(s.detail, s.wide_parts())) == 0


def test_sides_have_the_same_rows_as_by_transaction(dealt):
    s, src = dealt, dealt.src
    plain = {
        "media_path": enrich.media_path_totals(src.attribution, s.targets),
        "clicks": enrich.first_last_click(src.attribution, s.targets),
        "loyalty": enrich.loyalty_redemption(src.redemptions, s.targets),
        "service": enrich.customer_service(src.contacts, s.targets),
        "coupons": enrich.coupon_use(src.discounts, s.targets),
        "cabins": enrich.flight_class_list(src.segments, s.detail),
        "passengers": enrich.passengers(src.products, s.detail),
        "economics": enrich.economics(src.transactions, s.targets),
    }
    for name, rows in plain.items():
        mine = s.by_transaction(getattr(s, name))
        assert mine.columns == rows.columns, name
        assert mine.count() == rows.count() > 0 and mine.exceptAll(rows).count() == 0, name


def test_orders_with_several_buyers_are_not_dealt_by_user(spark, folder):
    whole = RetailSources(spark, FOLDER)
    assert whole.by_user("Confirmado", MANY) and not whole.by_user("Confirmado", 1)
    orders = whole.table("orders")
    one = orders.filter("o_orderstatus = 'F'").limit(1)
    for i, buyer in enumerate(("o_custkey + 1", "CAST(NULL AS BIGINT)")):
        shared = one.selectExpr("* EXCEPT (o_custkey)", f"{buyer} AS o_custkey").select(orders.columns)
        orders.unionByName(shared).write.parquet(f"{folder}/{i}/orders.parquet")
        assert not RetailSources(spark, f"{folder}/{i}").by_user("Confirmado", MANY)
        assert RetailSources(spark, f"{folder}/{i}").by_user("Pendiente", MANY)
