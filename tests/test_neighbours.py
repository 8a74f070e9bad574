import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from encore.operators import neighbours as N

ENCODING = N.Encoding(ordinals={"income": ("Unknown", "Low", "High")}, nominals=("pais", "kind"), numbers=("money",), flags=("flag",))


def users(spark, n, seed, copies=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "social_id": [f"{seed}-{i:04d}" for i in range(n)],
            "income": rng.choice(["Unknown", "Low", "High", "odd"], n),
            "pais": rng.choice(["AR", "BR", "CL", "XX" if seed == 2 else "AR"], n),
            "kind": rng.choice(["a", "b"], n),
            "money": np.round(rng.lognormal(1, 1, n), 1),
            "flag": rng.integers(0, 2, n),
        }
    )
    pdf.loc[pdf.index % 9 == 0, "kind"] = None
    if copies:
        pdf.loc[pdf.index < copies, ["income", "pais", "kind", "money", "flag"]] = ["Low", "AR", "a", 2.0, 1]
    return spark.createDataFrame(pdf), pdf


def one_hot(ask, ref, unseen):
    """Brute force by the plain definition: one-hot columns scaled on the reference group."""
    income = {"Unknown": 0, "Low": 1, "High": 2}

    def matrix(pdf):
        cols = {"income": pdf["income"].map(income).fillna(0), "money": pdf["money"], "flag": pdf["flag"]}
        for c in ("pais", "kind"):
            levels = sorted(set(ref[c].dropna()) | (set(ask[c].dropna()) if unseen else set()))
            for level in levels:
                cols[f"{c}={level}"] = (pdf[c] == level).astype(float)
        return pd.DataFrame(cols).to_numpy(dtype=float)

    r, q = matrix(ref), matrix(ask)
    scale = r.std(axis=0)
    scale[scale == 0] = 1
    return np.sqrt((((q / scale)[:, None, :] - (r / scale)[None, :, :]) ** 2).sum(axis=2))


def expected(ask, ref, k, unseen=False):
    d = np.round(one_hot(ask, ref, unseen), 9)
    out = {}
    for i, user in enumerate(ask["social_id"]):
        best = sorted(zip(d[i], ref["social_id"]))[:k]
        out[user] = [(rid, dist) for dist, rid in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "puesto").collect():
        out.setdefault(r["id"], []).append((r["vecino"], r["distancia"]))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for user in a:
        assert [x[0] for x in a[user]] == [x[0] for x in b[user]], user
        np.testing.assert_allclose([x[1] for x in a[user]], [x[1] for x in b[user]], atol=1e-8)


@pytest.mark.parametrize("blocks", [N.Blocks(), N.Blocks(pivots=7, targets=5, references=11), N.Blocks(pivots=1, targets=3, references=4)])
def test_join_is_exact_for_any_block_size(spark, blocks):
    ref, ref_pdf = users(spark, 120, 1, copies=40)
    ask, ask_pdf = users(spark, 30, 2, copies=10)
    same(found(N.nearest_users(ask, ref, ENCODING, 5, blocks)), expected(ask_pdf, ref_pdf, 5))


def test_levels_seen_only_by_targets_can_count(spark):
    ref, ref_pdf = users(spark, 60, 1)
    ask, ask_pdf = users(spark, 20, 2)
    encoding = N.Encoding(**{**ENCODING.__dict__, "unseen_weight": 1.0})
    same(found(N.nearest_users(ask, ref, encoding, 3)), expected(ask_pdf, ref_pdf, 3, unseen=True))


def test_fewer_references_than_neighbours(spark):
    ref, ref_pdf = users(spark, 3, 1)
    ask, ask_pdf = users(spark, 4, 2)
    same(found(N.nearest_users(ask, ref, ENCODING, 5)), expected(ask_pdf, ref_pdf, 5))


def test_no_references(spark):
    ref, _ = users(spark, 3, 1)
    ask, _ = users(spark, 4, 2)
    assert N.nearest_users(ask, ref.limit(0), ENCODING, 5).count() == 0


def test_votes(spark):
    near = spark.createDataFrame(
        [
            ("q", "r1", 0.0, 1), ("q", "r2", 1.0, 2), ("q", "r3", 1.0, 3),
            ("t", "r2", 1.0, 1), ("t", "r3", 1.0, 2), ("n", "r4", 1.0, 1), ("n", "r5", 2.0, 2),
        ],
        "id string, vecino string, distancia double, puesto int",
    )
    ref = spark.createDataFrame(
        [("r1", "A", 10), ("r2", "B", -3), ("r3", "C", 5), ("r4", None, None), ("r5", "", -1)], "social_id string, v string, days int"
    )
    rows = N.with_outcomes(near, ref, ["v", "days"])
    mode = N.weighted_mode("vecinos", "v")
    got = {
        r["id"]: tuple(r)[1:]
        for r in rows.select("id", mode.alias("m"), N.weighted_mean("vecinos", "days").alias("d"), N.agreement("vecinos", "v", mode).alias("a")).collect()
    }
    assert got["q"] == ("A", 10.0, 0.33)  # weight 1e6 at distance 0
    assert got["t"] == ("B", 5.0, 0.5)  # tie: the nearest; negative days do not count
    assert got["n"] == (None, None, 0.0)


def test_unknown_levels_are_reported(spark):
    ask, pdf = users(spark, 50, 2)
    got = {(r["variable"], r["valor"]): r["n"] for r in N.unknown_levels(ask, ENCODING.ordinals).collect()}
    assert got == {("income", "odd"): int((pdf["income"] == "odd").sum())}


def test_targets_are_sent_to_few_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 20, (40, 3))
    draw = lambda n: [(f"{i:05d}", [float(x) for x in centres[i % 40] + rng.normal(0, 1, 3)]) for i in range(n)]
    references, targets = draw(1200), draw(400)
    pivots = np.array([v for _, v in references[:40]])
    table = lambda rows: spark.createDataFrame(rows, "id string, v array<double>")
    held = N._assign(table(references), pivots, 3, 0, 5).toPandas()
    far = np.full(len(pivots), -np.inf)
    for cell, away in held.groupby("cell")["away"].max().items():
        far[cell] = away
    # With the distances of the own cells as bounds, most targets need no other cell.
    d = np.sqrt(((np.array([v for _, v in targets])[:, None] - np.array([v for _, v in references])[None]) ** 2).sum(2))
    bound = pd.DataFrame({"id": [i for i, _ in targets], "d": np.sort(d, axis=1)[:, 4]})
    asks = N._assign(table(targets), pivots, 3, 0, 5).drop("bound").join(spark.createDataFrame(bound).withColumnRenamed("d", "bound"), "id")
    assert N._routes(asks, pivots, far, 3, 0).count() < len(targets)
    exact = N.knn_join(table(targets), table(references), 3, 0, 5)
    got = {r["id"]: sorted(x["d"] for x in r["all"]) for r in exact.groupBy("id").agg(F.collect_list(F.struct(F.col("distancia").alias("d"))).alias("all")).collect()}
    for (i, _), row in zip(targets, np.sort(d, axis=1)[:, :5], strict=True):
        assert got[i] == pytest.approx(list(np.round(row, 9)))


def test_pairs_by_products_are_the_measured_ones(monkeypatch):
    """Few pairs are measured one by one, and the nearest are those of measuring all; points repeat, tie and lack levels."""
    rng = np.random.default_rng(5)

    def points(n, levels, far=0.0):
        z = rng.integers(-3, 4, (n, 4)) / 7 + rng.choice([0, 1e-10], (n, 4)) + far
        codes = rng.choice(levels, (n, 2)).astype(float)
        return np.hstack([z, codes, np.where(codes < 0, 0.0, 0.3 + codes)])

    for far in (0.0, 1000.0):
        r, q = points(900, [-1, 0, 1, 2], far), points(300, [-2, -1, 0, 1, 2], far)
        q[:20] = r[:20]
        d = np.round(np.sqrt(N._squared(q, r, 4, 2)), N.PLACES)
        expected = [(i, int(j), d[i, j]) for i in range(len(q)) for j in np.lexsort((np.arange(len(r)), d[i]))[:5]]
        ids = [f"{j:04}" for j in range(len(r))]
        measured, plain = [], N._close_pairs
        monkeypatch.setattr(N, "_close_pairs", lambda *a: (measured.append(len(x[0])) or x for x in plain(*a)))
        frame = lambda m, names: pd.DataFrame({"id": names, "v": list(m)})
        got = N._nearest(frame(q, list(range(len(q)))), frame(r, ids), 5, 4, 2)
        assert [(int(a), int(b), c) for a, b, c in zip(got["id"], got["vecino"], got["distancia"], strict=True)] == expected
        assert sum(measured) < len(q) * len(r) / 5
        monkeypatch.undo()
