"""Shared tables in buckets: the same rows as plain tables, and plans without exchanges between them."""

import re

import pytest

from encore.operators import grain, wide
from encore.plans.catalog import MODELLING, tidy
from encore.plans.stages import Layout, Stages, TableStore
from encore.sources.retail import RetailSources

FOLDER = "/root/testdata/sf0.001"


def stages(spark, layout):
    return Stages(RetailSources(spark, FOLDER), TableStore(spark), modelling=MODELLING, layout=layout)


@pytest.fixture(scope="module")
def both(spark):
    return stages(spark, Layout(buckets=4)), stages(spark, Layout(bucketed=False))


@pytest.fixture
def plain_joins(spark):
    """The tables are small here: without broadcasts the plan is that of large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df) -> int:
    return len(re.findall(r"^[^\n]*\bExchange ", df._jdf.queryExecution().executedPlan().toString(), re.M))


@pytest.mark.parametrize("name", ["detail", "wide", "tx_level", "user_level", "modeling_view"])
def test_same_rows(both, name):
    left, right = (getattr(s, name) for s in both)
    assert both[0].bucketed and not both[1].bucketed
    assert left.columns == right.columns and left.count() == right.count() > 0
    assert tidy(left).exceptAll(tidy(right)).count() == 0


def test_grains_read_the_wide_table_without_exchange(both, plain_joins):
    s = both[0]
    assert exchanges(grain.tx_level(s.wide, "social_id")) == 0
    assert exchanges(grain.user_level(s.wide)) == 0
    assert exchanges(grain.tx_level(both[1].wide)) == 1 and exchanges(grain.user_level(both[1].wide)) == 1


def test_the_wide_join_does_not_move_its_rows(both, plain_joins):
    s = both[0]
    parts = s.wide_parts()
    for name in ("purchase_lists", "products", "app", "profile", "economics", "coupons", "cabins", "payments", "passengers"):
        assert exchanges(parts[name]) == 0, name
    assert exchanges(s.detail.join(s.profile, "social_id").join(s.users.select("social_id"), "social_id")) == 0
    own = sum(exchanges(p) for p in parts.values())
    # Beyond what the raw sources of the parts need: the key list to the transactions, the transactions to their users, and the one part
    # that is keyed by an expression. The detail rows are read by the joins on users straight from their buckets.
    joined = wide.final_wide(s.detail, parts, True)
    assert exchanges(joined) <= own + 3
    assert exchanges(wide.final_wide(both[1].detail, both[1].wide_parts())) > own + 3


def test_heavy_users_and_shared_transactions_give_plain_tables(spark, both):
    assert not stages(spark, Layout(buckets=4, heaviest=1)).bucketed
    s = stages(spark, Layout(buckets=4))
    shared = both[0].confirmed.limit(1).selectExpr("* EXCEPT (social_id)", "'other' AS social_id").select(both[0].confirmed.columns)
    s.__dict__["confirmed"] = both[0].confirmed.unionByName(shared)
    assert not s.bucketed


def test_store_drops_its_tables(spark):
    s = stages(spark, Layout(buckets=2))
    _ = s.users
    name = s.store.tables[0]
    assert spark.catalog.tableExists(name)
    s.store.remove()
    assert not spark.catalog.tableExists(name) and not s.store.tables
