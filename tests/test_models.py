import math

import numpy as np
import pandas as pd
import pytest

from encore.operators import actions, evaluation, mart, propensity, survival


# --- survival ---------------------------------------------------------------------------------------------------


def km_by_hand(t, e):
    s, out = 1.0, {}
    for day in sorted(set(t)):
        n = sum(x >= day for x in t)
        d = sum(x == day and y for x, y in zip(t, e))
        s *= 1 - d / n
        out[day] = s
    return out


@pytest.mark.parametrize(
    "t, e", [([5, 5, 5, 8, 8, 12], [1, 0, 1, 1, 0, 1]), ([3, 3], [1, 1]), ([4, 9], [0, 0]), ([0, 2, 2, 7], [1, 1, 1, 0])]
)
def test_kaplan_meier(spark, t, e):
    rows = spark.createDataFrame(list(zip(t, e)), "T int, E int")
    got = {r["t"]: r["s"] for r in survival.kaplan_meier(rows).collect()}
    assert got == pytest.approx(km_by_hand(t, e))
    grid = [r["s"] for r in survival.survival_on_grid(survival.kaplan_meier(rows), [0, 4, 100]).orderBy("t").collect()]
    steps = km_by_hand(t, e)
    expected = [([1.0] + [s for day, s in steps.items() if day <= g])[-1] for g in (0, 4, 100)]
    assert grid == pytest.approx([round(x, 4) for x in expected])


def test_logrank_against_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(list("abcd"), 200), "T": rng.integers(1, 30, 200), "E": rng.integers(0, 2, 200)})
    names = sorted(pdf["g"].unique())
    z, cov = np.zeros(4), np.zeros((4, 4))
    for day in sorted(pdf.loc[pdf["E"] == 1, "T"].unique()):
        risk = pdf[pdf["T"] >= day]
        n, d = len(risk), ((pdf["T"] == day) & (pdf["E"] == 1)).sum()
        n_i = np.array([(risk["g"] == g).sum() for g in names])
        d_i = np.array([((pdf["T"] == day) & (pdf["E"] == 1) & (pdf["g"] == g)).sum() for g in names])
        z += d_i - d * n_i / n
        if n > 1:
            p = n_i / n
            cov += d * (n - d) / (n - 1) * (np.diag(p) - np.outer(p, p))
    chi2 = z[:3] @ np.linalg.solve(cov[:3, :3], z[:3])
    got = survival.multivariate_logrank(spark.createDataFrame(pdf), {"x": ("g", 4)}, min_n=1).first()
    assert got["chi2"] == pytest.approx(chi2) and got["grados"] == 3
    assert got["p_value"] == pytest.approx(survival.chi_square_tail(chi2, 3))


def test_chi_square_tail():
    # Known 5 % points.
    for df, x in {1: 3.841459, 2: 5.991465, 3: 7.814728, 4: 9.487729, 5: 11.070498}.items():
        assert survival.chi_square_tail(x, df) == pytest.approx(0.05, abs=1e-6)


def test_groups_never_at_risk_together(spark):
    """One group is over before the other begins to have events: nothing to compare. A third that is makes one degree of freedom."""
    apart = spark.createDataFrame([("a", 2, 0), ("a", 3, 0), ("b", 5, 1), ("b", 6, 1)], "g string, T int, E int")
    row = survival.multivariate_logrank(apart, {"x": ("g", 2)}, min_n=1).first()
    assert row["grados"] == 0 and row["chi2"] is None and row["p_value"] is None
    three = apart.unionByName(spark.createDataFrame([("c", 5, 0), ("c", 9, 1)], "g string, T int, E int"))
    row = survival.multivariate_logrank(three, {"x": ("g", 3)}, min_n=1).first()
    assert row["grados"] == 1 and row["p_value"] == pytest.approx(survival.chi_square_tail(row["chi2"], 1))


def test_single_group_has_no_test(spark):
    rows = spark.createDataFrame([("a", 3, 1), ("a", 4, 0)], "g string, T int, E int")
    assert survival.multivariate_logrank(rows, {"x": ("g", 2)}, min_n=1).count() == 0


# --- evaluation -------------------------------------------------------------------------------------------------


def auc_by_hand(y, p):
    pos, neg = [s for s, l in zip(p, y) if l], [s for s, l in zip(p, y) if not l]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def ap_by_hand(y, p):
    total, out, seen_recall = sum(y), 0.0, 0.0
    for cut in sorted(set(p), reverse=True):
        hit = [l for s, l in zip(p, y) if s >= cut]
        recall = sum(hit) / total
        out += (recall - seen_recall) * sum(hit) / len(hit)
        seen_recall = recall
    return out


CASES = {
    "tied": ([0, 1, 0, 1, 1, 0], [0.5] * 6),
    "perfect": ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]),
    "inverted": ([1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9]),
    "mixed": ([0, 1, 1, 0, 1, 0, 0, 1], [0.0, 0.1, 0.10001, 1.0, 0.5, 0.5, 0.3, 1.0]),
}


@pytest.mark.parametrize("name", CASES)
def test_auc_and_average_precision(spark, name):
    y, p = CASES[name]
    rows = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(zip(y, p))], "id string, label int, score double")
    assert evaluation.roc_auc(rows).first()["roc_auc"] == pytest.approx(auc_by_hand(y, p))
    assert evaluation.average_precision(rows).first()["pr_auc"] == pytest.approx(ap_by_hand(y, p))
    grouped = evaluation.grouped_auc(rows.selectExpr("'g' AS g", "*"), ["g"]).first()["roc_auc"]
    assert grouped == pytest.approx(auc_by_hand(y, p))


def test_single_class_has_no_auc(spark):
    rows = spark.createDataFrame([("a", 1, 0.3), ("b", 1, 0.4)], "id string, label int, score double")
    assert evaluation.roc_auc(rows).first()["roc_auc"] is None


def test_calibration_bins_are_right_closed(spark):
    rows = spark.createDataFrame([(0, 0.0), (1, 0.1), (0, 0.10001), (1, 1.0)], "label int, score double")
    assert [(r["bin"], r["n"]) for r in evaluation.calibration(rows).collect()] == [(0, 2), (1, 1), (9, 1)]


@pytest.mark.parametrize("n", [10, 11, 23, 97])
def test_deciles_match_equal_frequency_bins(spark, n):
    rows = spark.createDataFrame([(str(i), i % 2, 0.25 if i % 3 == 0 else i / n) for i in range(n)], "id string, label int, score double")
    ranks = evaluation.score_rank(rows, "id").collect()
    assert sorted(r["rango"] for r in ranks) == list(range(1, n + 1))
    assert [r["score"] for r in sorted(ranks, key=lambda r: r["rango"])] == sorted(r["score"] for r in ranks)
    got = {r["decile"]: r["n"] for r in evaluation.decile_lift(rows, "id").collect()}
    expected = pd.Series(pd.qcut(np.arange(1, n + 1), 10, labels=False)).value_counts().to_dict()
    assert got == expected


# --- propensity -------------------------------------------------------------------------------------------------


def model_rows(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"social_id": [str(i) for i in range(n)], "cohort_month": rng.choice(["2023-01", "2024-08", "2024-09"], n)})
    for c in propensity.CATEGORIES:
        pdf[c] = rng.choice(["b", "a", "c"], n)
    pdf.loc[pdf.index % 7 == 0, "pais"] = None
    for c in propensity.FLAGS:
        pdf[c] = rng.integers(0, 2, n)
    for c in propensity.NUMBERS:
        pdf[c] = rng.normal(3, 2, n)
    pdf["label"] = (rng.random(n) < 1 / (1 + np.exp(-(pdf["flg_uso_puntos"] * 1.5 - 1)))).astype(int)
    return spark.createDataFrame(pdf), pdf


def test_design_drops_the_first_level_and_scales_by_population_deviation(spark):
    rows, pdf = model_rows(spark)
    design = propensity.design_matrix(rows)
    assert [n for n in design.names if n.startswith("pais_")] == ["pais_c", "pais_b"]
    assert "pais_a" not in design.names and not any("null" in n for n in design.names)
    cells = propensity.design_rows(design, rows).toPandas()
    money = cells[cells["feature"] == "log_gross_bookings"].set_index("social_id")["value"]
    raw = pdf.set_index("social_id")["log_gross_bookings"]
    np.testing.assert_allclose(money.loc[raw.index], (raw - raw.mean()) / raw.std(ddof=0))
    other, _ = model_rows(spark, 50, 5)
    unseen = other.selectExpr("* EXCEPT (pais)", "'zz' AS pais")
    assert propensity.design_rows(design, unseen).filter("feature LIKE 'pais%'").count() == 0


def test_logistic_matches_newton(spark):
    rows, pdf = model_rows(spark)
    fit = propensity.logistic_l2(rows, c=1.0)
    cells = propensity.design_rows(fit.design, rows).toPandas().pivot(index="social_id", columns="feature", values="value").fillna(0.0)
    names = list(fit.design.names)
    x = cells.reindex(index=pdf["social_id"], columns=names, fill_value=0.0).to_numpy()
    x, y = np.column_stack([x, np.ones(len(x))]), pdf["label"].to_numpy()
    penalty = np.diag([1.0] * len(names) + [0.0])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ beta)
    np.testing.assert_allclose([fit.coefficients[n] for n in names], beta[:-1], atol=2e-3)
    assert fit.intercept == pytest.approx(beta[-1], abs=2e-3)


def test_collapse_rare_and_split(spark):
    rows = spark.createDataFrame([("x", "2024-07")] * 3 + [("y", "2024-08")] + [(None, "2024-09")], "pais string, cohort_month string")
    got = propensity.collapse_rare(rows, ["pais"], min_count=2)
    assert sorted((r["pais"] or "") for r in got.collect()) == ["", "Otros", "x", "x", "x"]
    train, test = propensity.temporal_split(rows)
    assert (train.count(), test.count()) == (3, 2)


def test_boosted_trees_save_and_importance(spark, folder):
    rows, _ = model_rows(spark)
    booster = propensity.boosted_trees(rows, max_depth=3, max_iter=5)
    scored = propensity.predict(booster.model, rows)
    auc = evaluation.roc_auc(scored).first()["roc_auc"]
    assert 0.55 < auc <= 1.0
    flipped = scored.selectExpr("label", "1 - score AS score")
    assert evaluation.roc_auc(flipped).first()["roc_auc"] == pytest.approx(1 - auc)
    importance = {r["feature"]: r["importance"] for r in propensity.permutation_importance(propensity.scorer(booster.model), rows, repeats=2).collect()}
    assert max(importance, key=importance.get) == "flg_uso_puntos" and min(importance.values()) >= 0
    kept = propensity.Booster(booster.model, booster.median_account_age, booster.levels, importance)
    propensity.save_model(spark, kept, folder)
    again = propensity.load_model(spark, folder)
    assert again.importance == pytest.approx(importance) and again.levels == {c: list(v) for c, v in booster.levels.items()}
    same = propensity.predict(again.model, rows).join(scored.select("social_id", scored["score"].alias("old")), "social_id")
    assert same.filter("abs(score - old) > 1e-12").count() == 0
    dependence = propensity.partial_dependence(propensity.scorer(booster.model), rows, "flg_uso_puntos").collect()
    assert [r["grid"] for r in dependence] == [0.0, 1.0] and dependence[1]["avg_pred"] > dependence[0]["avg_pred"]


def test_trees_see_every_row(spark, monkeypatch):
    """No sample of the rows, and thresholds from all of them: Spark reads ``maxBins`` squared rows for those."""
    monkeypatch.setattr(propensity, "seeded_sample", None)
    rows, _ = model_rows(spark, 1500)
    model = propensity.boosted_trees(rows, max_depth=5, max_iter=2).model.stages[-1]
    assert model.getOrDefault("maxBins") ** 2 >= rows.count() > 32**2
    trees = propensity.trees_of(spark, model)
    numbers = trees.feature >= len(propensity.CATEGORIES)
    assert numbers.any() and (trees.level[numbers] < 0).all() and (trees.level[(trees.feature >= 0) & ~numbers] >= 0).all()
    rows = spark.range(3000).selectExpr("cast(id as double) AS many", "if(id = 7, 1, 0) + if(id = 8, 5, 0) AS few", "cast(null as int) AS none")
    edges = propensity.bin_edges(rows, ("many", "few", "none"))
    assert edges["few"] == [1.0, 5.0] and edges["none"] == []
    assert edges["many"] == pytest.approx([2999 * i / 32 for i in range(1, 32)])


def test_tree_importance_is_that_of_copied_rows(spark, monkeypatch):
    """A row is scored with its donors' features in place, without a copy of the row; same figures as with copies."""
    rows, _ = model_rows(spark, 700)
    model = propensity.boosted_trees(rows, max_depth=4, max_iter=6).model
    trees = propensity.trees_of(spark, model.stages[-1])
    matrix = propensity.PipelineModel(stages=model.stages[:-1]).transform(propensity._filled(rows)).select("social_id", "features").collect()
    x = np.array([r["features"].toArray() for r in matrix])
    expected = {r["social_id"]: r["score"] for r in propensity.predict(model, rows).collect()}
    assert trees.scores(trees.outputs(x, range(len(trees.weights)))) == pytest.approx([expected[r["social_id"]] for r in matrix], abs=1e-12)
    monkeypatch.setattr(propensity, "COUNTED_ROWS", 50)
    features = [*propensity.FEATURES][::-1]
    fast = {r["feature"]: r["importance"] for r in propensity.permutation_importance(propensity.scorer(model), rows, features, 2).collect()}
    slow = {r["feature"]: r["importance"] for r in propensity.permutation_importance(lambda t: propensity.predict(model, t), rows, features, 2).collect()}
    assert fast == pytest.approx(slow, abs=1e-6) and max(fast.values()) > 0
    monkeypatch.setattr(propensity, "RANKED_ROWS", 90)
    ranges = {r["feature"]: r["importance"] for r in propensity.permutation_importance(propensity.scorer(model), rows, features, 2).collect()}
    assert ranges == pytest.approx(fast, abs=1e-12)
    assert {r["importance"] for r in propensity.permutation_importance(propensity.scorer(model), rows.limit(0), features, 2).collect()} == {0.0}


# --- actions and mart -------------------------------------------------------------------------------------------


def test_levers_and_segments(spark):
    rows = spark.createDataFrame(
        [("all", 0, 0, 0, 0, 0.35), ("none", 1, 1, 1, 1, 0.34996), ("one", 1, 0, 1, 1, 0.2), ("low", 0, 1, 0, 0, 0.19999)],
        "social_id string, flg_app_90d_antes_trip1 int, flg_uso_puntos int, flg_multi_instrumento_pago int, flg_uso_cupon int, score double",
    )
    got = {
        r["social_id"]: (r["segmento"], r["p_rebuy_18m"], r["palanca_1"], r["palanca_2"])
        for r in actions.score_and_segment(actions.next_best_levers(rows, {"flg_uso_puntos": 0.5, "flg_uso_cupon": 0.1})).collect()
    }
    assert got["all"] == ("alto", 0.35, "Enrollar en Loyalty", "Activar con cupón")
    assert got["none"] == ("medio", 0.35, "Oferta personalizada", "Reactivación por email")
    assert got["one"] == ("medio", 0.2, "Enrollar en Loyalty", "Reactivación por email")
    # Equal weights: names from Z to A.
    assert got["low"] == ("bajo", 0.2, "Activar con cupón", "Diversificar medios de pago")


def test_unseen_levels(spark):
    rows, _ = model_rows(spark, 20)
    levels = {c: ["a", "b"] for c in propensity.CATEGORIES} | {"pais": ["a", "Otros"]}
    got = actions.known_levels(rows, levels).select("pais", "income").toPandas()
    assert set(got["pais"]) <= {"a", "Otros"} and set(got["income"].dropna()) <= {"a", "b"} and got["income"].isna().any()


def test_main_product_and_codes(spark):
    rows = spark.createDataFrame(
        [("Hoteles | Vuelos", "Low"), ("Vuelos", None), ("Asistencia al viajero | Autos", "High"), (None, "?")], "p string, i string"
    )
    got = rows.select(mart.main_product("p"), mart.ordered_code("i", mart.INCOME_ORDER)).collect()
    assert [tuple(r) for r in got] == [
        ("Paquete (Vuelos+Hoteles)", 1), ("Vuelos", -1), ("Asistencia al viajero", 3), ("Otro", -1),
    ]
    coded = mart.dictionary_encode(rows, "p", "code").select("p", "code").collect()
    assert {r["p"]: r["code"] for r in coded} == {"Asistencia al viajero | Autos": 0, "Hoteles | Vuelos": 1, None: 2, "Vuelos": 3}


def test_logistic_score(spark):
    rows = spark.createDataFrame([(2.0, "a"), (0.0, "b")], "x double, c string")
    score = propensity.logistic_score({"x": 0.5, "c=a": -1.0}, 0.25, {"x": (1.0, 2.0)})
    got = [r[0] for r in rows.select(score).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(0.5)), 1 / (1 + math.exp(0.0))])
