import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from encore.operators import bootstrap, propensity
from encore.plans import registry
from encore.plans.catalog import CATALOG, stages_for


def table(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 2, 0.5]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [0.8, -0.4, 0.0] - 0.5)))).astype(float)
    rows = [(f"u{i}", Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, ["social_id", "features", "label"]).repartition(5)


def test_draws_are_the_samples(spark):
    _, _, matrix = table(spark)
    drawn = bootstrap.drawn_rows(matrix, 7, 150).select("draws", "x").collect()
    assert np.sum([r["draws"] for r in drawn], axis=0).tolist() == [150] * 7
    sampled = propensity.bootstrap_samples(matrix, 7, 150).join(matrix, "social_id").collect()
    expected = {(r["muestra"], tuple(r["features"].toArray())) for r in sampled}
    assert {(i, tuple(r["x"])) for r in drawn for i, t in enumerate(r["draws"]) if t} == expected
    everyone = bootstrap.drawn_rows(matrix, 3, 10_000).select("draws").distinct().collect()
    assert [list(r["draws"]) for r in everyone] == [[1, 1, 1]]


def test_coefficients_equal_single_fits(spark):
    _, _, matrix = table(spark)
    got = {(r["muestra"], r["feature"]): r["beta"] for r in bootstrap.bootstrap_fits(matrix, ("a", "b", "c"), 5, 200).collect()}
    assert len(got) == 15
    for i in range(5):
        rows = propensity.seeded_sample(matrix, 200, "social_id", 1000 + i)
        single = propensity._fitted(rows, 1.0, 200).coefficients.toArray()
        assert [got[i, f] for f in "abc"] == pytest.approx(single, abs=1e-5)


def test_slope_is_zero_at_the_solution(spark):
    x, y, matrix = table(spark, 300, 1)
    rows = bootstrap.drawn_rows(matrix, 2, 300)
    beta = bootstrap.fit_draws(rows, 2, 3)[1]
    p = 1 / (1 + np.exp(-(x @ beta[:3] + beta[3])))
    assert np.abs((p - y) @ x + beta[:3]).max() < 1e-6 and abs((p - y).sum()) < 1e-6


def test_with_replacement_and_blocks_of_draws(spark, monkeypatch):
    _, _, matrix = table(spark)
    drawn = bootstrap.drawn_rows(matrix, 20, 600, True).select("draws").collect()
    counts = np.array([r["draws"] for r in drawn])
    assert counts.mean() == pytest.approx(1.0, abs=0.05) and counts.var() == pytest.approx(1.0, abs=0.1) and counts.max() > 1
    rows = bootstrap.drawn_rows(matrix, 4, 300)
    whole = bootstrap.fit_draws(rows, 4, 3)
    monkeypatch.setattr(bootstrap, "CURVATURE_CELLS", 20)
    assert np.allclose(bootstrap.fit_draws(rows, 4, 3), whole, atol=1e-9)


def test_scans_do_not_grow_with_the_draws(spark):
    _, _, matrix = table(spark)
    steps = []
    plain = bootstrap._step
    for n in (2, 30):
        seen = []
        bootstrap._step = lambda *a: seen.append(1) or plain(*a)
        try:
            bootstrap.fit_draws(bootstrap.drawn_rows(matrix, n, 200), n, 3)
        finally:
            bootstrap._step = plain
        steps.append(len(seen))
    assert steps[1] <= steps[0] + 2


def test_empty_matrix(spark):
    _, _, matrix = table(spark)
    assert bootstrap.bootstrap_fits(matrix.limit(0), ("a", "b", "c"), 3, 10).count() == 9


def test_the_registered_interval_draws_as_many_rows_as_there_are(spark, monkeypatch):
    kept, keep = [], bootstrap.written
    monkeypatch.setattr(bootstrap, "written", lambda df, name: kept.append(df) or keep(df, name))
    stages = stages_for(spark, "/root/testdata/sf0.01")
    assert "bootstrap_ci" in registry.queries()
    found = CATALOG["bootstrap_ci"].build(stages).collect()
    assert found and all(r["ordered"] and r["share"] for r in found)
    counts = np.array([r["draws"] for r in kept[0].collect()])
    assert counts.shape == (stages.model_split[0].count(), 100)
    assert counts.mean() == pytest.approx(1.0, abs=0.05) and counts.var() == pytest.approx(1.0, abs=0.1)
