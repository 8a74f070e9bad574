"""What the plans must and must not contain."""

import pytest

import __spark_entry__ as contract
from encore.plans.catalog import CATALOG, stages_for

FOLDER = "/root/testdata/sf0.001"
FITTED = {
    "logistic_l2", "bootstrap_ci", "boosted_trees", "permutation_importance", "partial_dependence", "save_load_model", "score_audience",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in CATALOG if n not in FITTED])
def test_no_nested_loop_joins(spark, name):
    plan = plan_of(contract.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_ranks_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(contract.queries()["first_second_trip"](spark, FOLDER))


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(contract.queries()["kpi_by_horizon"](spark, FOLDER))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "destino_trip" not in scan and "eligible_6m" in scan
    speed = plan_of(contract.queries()["repeat_speed_buckets"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(rebuy_ever), EqualTo(rebuy_ever,true)]" in speed


def test_one_scan_for_all_cuts(spark):
    plan = plan_of(contract.queries()["categorical_breakdown"](spark, FOLDER))
    assert plan.count("FileScan") == 1


def test_visits_are_cut_by_literal_dates(spark):
    plan = plan_of(contract.queries()["activity_between_trips"](spark, FOLDER))
    assert "visit_date" in plan or "date_format" in plan
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_shared_tables_are_written_once(spark):
    assert stages_for(spark, FOLDER) is stages_for(spark, FOLDER + "/")


def test_visits_are_read_once_each_and_no_row_is_copied(spark):
    plan = plan_of(contract.queries()["app_behaviour"](spark, FOLDER))
    assert "Expand" not in plan and plan.count("events.parquet") <= 1
    assert "Expand" not in plan_of(contract.queries()["payment_methods"](spark, FOLDER))


def test_the_mart_reads_its_rows_once_for_all_dictionaries(spark):
    plan = plan_of(contract.queries()["recommendation_mart"](spark, FOLDER))
    assert plan.count("Exchange hashpartitioning") <= 2 and "Window" not in plan
