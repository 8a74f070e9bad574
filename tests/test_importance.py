import random

import pytest

from encore.operators import propensity
from tests.test_plans import plan_of

FEATURES = ("a", "b", "kind", "idle")
SCORE = propensity.Additive({"a": 0.8, "b": -1.5, "kind=x": 0.7, "kind=y": -0.2, "other": 0.4}, -0.3, {"b": (2.0, 0.5)})


def rows(spark, n):
    rng = random.Random(n)
    made = []
    for i in range(n):
        a, b, kind = rng.random(), rng.gauss(2, 0.5), rng.choice(["x", "y", "z", None])
        made.append((f"u{i}", int(rng.random() < (0.7 if a > b - 1.5 else 0.3)), a, b, kind, rng.random(), 1.0))
    return spark.createDataFrame(made, "social_id string, label int, a double, b double, kind string, idle double, other double").repartition(4)


@pytest.mark.parametrize("n", [40, 400])
def test_same_as_copying_every_row(spark, n):
    table = rows(spark, n).withColumn("other", propensity.F.lit(1.0))
    features = (*FEATURES, "other")
    fast = {r["feature"]: r["importance"] for r in propensity.permutation_importance(SCORE, table, features, 3).collect()}
    slow = {r["feature"]: r["importance"] for r in propensity.permutation_importance(lambda t: SCORE(t), table, features, 3).collect()}
    assert fast.keys() == slow.keys() and fast == pytest.approx(slow, abs=1e-9)
    assert fast["idle"] == 0 and fast["b"] > 0


def test_no_row_is_copied(spark):
    counts = propensity._shuffled_counts(SCORE, rows(spark, 60).withColumn("other", propensity.F.lit(1.0)), (*FEATURES, "other"), 2, 42)
    plan = plan_of(counts)
    assert "Generate" not in plan and "Expand" not in plan
    assert counts.count() <= 5 * 2 * 60
    assert counts.groupBy("feature", "_repeat").agg(propensity.F.sum(propensity.F.col("pos") + propensity.F.col("neg")).alias("n")).filter("n <> 60").count() == 0


@pytest.mark.parametrize("score", [SCORE, lambda t: SCORE(t)])
def test_nothing_is_broadcast(spark, score):
    """Rows, donors and starts of buckets grow with the table: the driver must not hold them, however small they look when shuffled."""
    found = propensity.permutation_importance(score, rows(spark, 200), (*FEATURES, "other"), 2)
    found.collect()
    plan = plan_of(found)
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastExchange" not in plan
