import numpy as np
import pytest

from encore.operators import lsh, neighbours as N
from encore.plans.catalog import stages_for
from tests.test_neighbours import ENCODING, users


def points(spark, rng, n, name, axes=6, groups=40):
    """Clusters with two categories: (id, v) as the joins take it."""
    centres = np.random.default_rng(0).normal(0, 6, (groups, axes))
    at = rng.integers(0, groups, n)
    x = centres[at] + rng.normal(0, 0.5, (n, axes))
    codes = np.stack([at % 3 + 1, rng.integers(1, 4, n)], axis=1).astype(float)
    v = np.concatenate([x, codes, np.full((n, 2), 1.5)], axis=1)
    return v, spark.createDataFrame([(f"{name}{i:05d}", row.tolist()) for i, row in enumerate(v)], "id string, v array<double>")


def test_projected_distance_is_the_mixed_metric():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(2, 5)), [[1, 7], [2, 7]], [[2.0, 3.0], [0.5, 3.0]]], axis=1)
    p = lsh.Projections(lsh.Tables(tables=400, functions=10), 5, 2, 1.0).places(v)
    assert np.mean((p[0] - p[1]) ** 2) == pytest.approx(N._squared(v[:1], v[1:], 5, 2)[0, 0], rel=0.1)
    assert np.array_equal(lsh._normals(np.array([3.0, -2.0]), 1, 4, 11), np.stack([lsh._normals(np.array([x]), 1, 4, 11)[0] for x in (3.0, -2.0)]))


def test_finds_most_with_few_candidates(spark):
    rng = np.random.default_rng(1)
    _, refs = points(spark, rng, 4000, "r")
    _, asks = points(spark, rng, 300, "t")
    exact = N.knn_join(asks, refs, 6, 2)
    found = lsh.lsh_join(asks, refs, 6, 2)
    row = lsh.recall(found, exact).first()
    assert (row["n"], row["pares"]) == (300, 1500) and row["recall"] >= 0.9
    true = {(r["id"], r["vecino"]): r["distancia"] for r in exact.collect()}
    got = {(r["id"], r["vecino"]): r["distancia"] for r in found.collect()}
    assert len(got) == 1500 and all(got[k] == pytest.approx(true[k], abs=1e-8) for k in got.keys() & true.keys())
    pairs = lsh.candidates(asks, refs, lsh.fit(refs, asks, 6, 2)).count()
    assert pairs < 0.2 * 300 * 4000


def test_crowded_cells_are_split(spark):
    rng = np.random.default_rng(2)
    _, refs = points(spark, rng, 1500, "r", groups=2)
    _, asks = points(spark, rng, 100, "t", groups=2)
    plain, split = (lsh.fit(refs, asks, 6, 2, tables=lsh.Tables(crowd=c)) for c in (10**6, 50))
    assert lsh.candidates(asks, refs, split).count() < lsh.candidates(asks, refs, plain).count()


def test_every_target_gets_its_neighbours(spark):
    """Far targets, equal points, fewer references than neighbours, none at all."""
    rng = np.random.default_rng(3)
    v, refs = points(spark, rng, 60, "r")
    far = spark.createDataFrame([("x", (np.append(np.full(6, 900.0), v[0][6:])).tolist()), ("y", v[5].tolist()), ("z", v[5].tolist())], "id string, v array<double>")
    found = {}
    for r in lsh.lsh_join(far, refs, 6, 2).collect():
        found.setdefault(r["id"], []).append((r["puesto"], r["vecino"], r["distancia"]))
    assert {k: len(x) for k, x in found.items()} == {"x": 5, "y": 5, "z": 5}
    assert sorted(found["y"]) == sorted(found["z"]) and sorted(found["y"])[0] == (1, "r00005", 0.0)
    exact = N.knn_join(far.filter("id = 'x'"), refs, 6, 2).collect()
    assert sorted(found["x"]) == sorted((r["puesto"], r["vecino"], r["distancia"]) for r in exact)
    assert lsh.lsh_join(far, refs.limit(3), 6, 2).groupBy("id").count().filter("count = 3").count() == 3
    assert lsh.lsh_join(far, refs.limit(0), 6, 2).count() == 0


def test_users_with_levels_the_references_lack(spark):
    ref, ref_pdf = users(spark, 400, 1, copies=60)
    ask, ask_pdf = users(spark, 80, 2)
    exact = N.nearest_users(ask, ref, ENCODING)
    found = lsh.approximate_users(ask, ref, ENCODING, tables=lsh.Tables(tables=6))
    assert lsh.recall(found, exact).first()["recall"] >= 0.9
    assert found.groupBy("id").count().filter("count = 5").count() == 80


def test_copies_of_rows(spark):
    """Targets are copied as keys, nine each, whatever the number of references; the exact join sends them to most of its cells."""
    stages = stages_for(spark, "/root/testdata/sf0.01")
    reference, target = stages.knn_groups
    scaling = N.fit_scaling(N.encode_points(reference))
    held, asked = (N.scaled_points(N.encode_points(x), scaling) for x in (reference, target))
    projections = lsh.fit(held, asked, 11, 5)
    assert lsh.cells(asked, projections, True).count() == 9 * asked.count()
    assert lsh.cells(held, projections, False).count() == 3 * held.count()


def test_cells_in_blocks_keep_the_best_of_all_candidates(spark):
    """Whole cells and cells cut into blocks: the k nearest of all pairs that meet, without a row for each pair."""
    rng = np.random.default_rng(6)
    _, refs = points(spark, rng, 600, "r", groups=4)
    _, asks = points(spark, rng, 50, "t", groups=4)
    projections = lsh.fit(refs, asks, 6, 2)
    v = {name: {r["id"]: np.array(r["v"]) for r in df.collect()} for name, df in (("r", refs), ("t", asks))}
    expected = {}
    for r in lsh.candidates(asks, refs, projections).collect():
        d = round(float(np.sqrt(N._squared(v["t"][r["id"]][None], v["r"][r["vecino"]][None], 6, 2)[0, 0])), N.PLACES)
        expected.setdefault(r["id"], []).append((d, r["vecino"]))
    for blocks in (N.Blocks(), N.Blocks(targets=7, references=20)):
        got = {}
        for r in lsh.ranked(asks, refs, projections, 5, blocks).collect():
            got.setdefault(r["id"], []).append((r["distancia"], r["vecino"]))
        assert {i: [x[1] for x in sorted(f)] for i, f in got.items()} == {i: [x[1] for x in sorted(f)[:5]] for i, f in expected.items()}
    plan = lsh.ranked(asks, refs, projections, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
