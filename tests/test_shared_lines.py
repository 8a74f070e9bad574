"""The order lines behind the source tables: joined and moved once, and the same rows as without storing them."""

import pytest

from encore.operators import enrich, grain, trips
from encore.plans.stages import Layout, Stages, TableStore
from encore.sources.retail import RetailSources
from tests.test_layout import FOLDER, exchanges, plain_joins, stages  # noqa: F401

TABLES = ("transactions", "trips", "attribution", "segments", "discounts", "products", "redemptions", "contacts", "payments")


@pytest.fixture(scope="module")
def shared(spark):
    return stages(spark, Layout(buckets=4))


@pytest.mark.parametrize("name", TABLES)
def test_stored_lines_give_the_same_rows(spark, shared, name):
    plain, stored = getattr(RetailSources(spark, FOLDER), name), getattr(shared.src, name)
    assert plain.columns == stored.columns and plain.count() == stored.count() > 0
    assert plain.exceptAll(stored).count() == 0


def test_tables_of_transactions_meet_the_key_list_without_exchange(shared, plain_joins):  # noqa: F811
    s = shared
    assert exchanges(trips.confirmed_transactions(s.src.transactions, s.scope)) == 0
    assert exchanges(enrich.coupon_use(s.src.discounts, s.targets)) == 0
    assert exchanges(enrich.economics(s.src.transactions, s.targets)) == 0
    assert exchanges(enrich.first_last_click(s.src.attribution, s.targets)) == 0
    assert exchanges(enrich.media_path_totals(s.src.attribution, s.targets)) == 0
    assert exchanges(enrich.customer_service(s.src.contacts, s.targets)) == 0
    # Details move once: to their users.
    assert exchanges(trips.trip_detail(s.users, s.src.trips, s.confirmed, s.scope)) == 1


def test_users_meet_their_first_trip_without_exchange(shared, plain_joins):  # noqa: F811
    s = shared
    assert exchanges(s.user_level.join(grain.trip1_agg(s.tx_level), "social_id", "left")) == 0


def test_facts_are_the_lines_of_confirmed_orders(spark, shared):
    whole, some = RetailSources(spark, FOLDER), shared.facts
    kept = whole.transactions.filter("transaction_status = 'Confirmado'")
    assert 0 < kept.count() < whole.transactions.count()
    assert kept.exceptAll(some.transactions).count() == 0 == some.transactions.exceptAll(kept).count()
    codes = whole._lines.filter("status = 'Confirmado'").select("transaction_code").distinct()
    for name in ("segments", "discounts", "products", "contacts", "payments"):
        rows = getattr(whole, name).join(codes, "transaction_code", "left_semi")
        assert rows.exceptAll(getattr(some, name)).count() == 0 and rows.count() == getattr(some, name).count() > 0


def test_buckets_grow_with_the_source(spark):
    s = Stages(RetailSources(spark, FOLDER), TableStore(spark), layout=Layout(rows=500))
    assert s.buckets == -(-s.src.size // 500) > 4
    assert Stages(RetailSources(spark, FOLDER), TableStore(spark)).buckets == 4


def test_lines_of_unknown_buyers_sellers_and_parts(spark, folder):
    whole = RetailSources(spark, FOLDER)
    for name, keep in {"customer": "c_custkey % 3 > 0", "supplier": "s_suppkey % 4 > 0", "part": "p_partkey % 5 > 0"}.items():
        whole.table(name).filter(keep).write.parquet(f"{folder}/{name}.parquet")
    for name in ("orders", "lineitem", "nation"):
        whole.table(name).write.parquet(f"{folder}/{name}.parquet")
    src, lines = RetailSources(spark, folder), whole.table("lineitem").join(whole.table("orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    placed, typed = "o_custkey % 3 > 0 AND l_suppkey % 4 > 0", "l_partkey % 5 > 0"
    assert src.attribution.count() == lines.count()
    assert src.transactions.count() == lines.filter(placed).count() < lines.count()
    assert src.segments.count() == lines.filter(typed).count() < lines.count()
    assert src.trips.count() == lines.filter(f"{placed} AND {typed}").count()
