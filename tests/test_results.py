"""Every registered result against its SQL, on the smallest data folder."""

import pytest

import __spark_entry__ as contract
from encore.plans import registry
from tests.compare import database, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_result(spark, con, name):
    rows = QUERIES[name](spark, FOLDER)
    if name not in ORACLE:
        assert rows.count() > 0
        return
    # This folder is too small for some segment minimums; both sides are empty then.
    found = [f for f in differences(rows, con, ORACLE[name]) if f != "empty"]
    assert not found, found


def test_flagship(spark):
    rows = contract.entry(spark).collect()
    assert [r["horizon"] for r in sorted(rows)] == [6, 12, 18, 24, 36]
    assert all(r["n_rebuy"] <= r["n_eligible"] for r in rows)
