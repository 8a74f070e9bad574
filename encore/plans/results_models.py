"""Registered results: survival, propensity, scoring, neighbours, mart, quality. Sizes are scaled to the sample data."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import actions, evaluation, lsh, mart, neighbours, propensity, quality, survival
from ..operators.bootstrap import bootstrap_fits
from ..oracle import models_sql as sql
from ..session import written
from .catalog import result
from .stages import Stages

EPOCH = "1995-01-01"


# --- survival ---------------------------------------------------------------------------------------------------


@result("duration_event", "V1", "SELECT * FROM durations")
def _(s: Stages):
    return survival.duration_event(s.modeling_view)


@result("kaplan_meier", "V2", "SELECT * FROM km")
def _(s: Stages):
    return survival.kaplan_meier(survival.duration_event(s.modeling_view))


@result(
    "survival_on_grid",
    "V3",
    "SELECT t, round_even(coalesce((SELECT arg_max(s, k.t) FROM km k WHERE k.t <= g.t), 1.0), 4) AS s FROM grid g",
)
def _(s: Stages):
    return survival.survival_on_grid(survival.kaplan_meier(survival.duration_event(s.modeling_view)))


@result(
    "group_kaplan_meier",
    "V4",
    """SELECT k.*, g.t, round_even(coalesce((SELECT arg_max(s, c.t) FROM group_km c WHERE c.grupo = k.grupo AND c.valor = k.valor AND c.t <= g.t), 1.0), 4) AS s
    FROM group_tops k, grid g""",
)
def _(s: Stages):
    return survival.group_kaplan_meier(survival.duration_event(s.modeling_view), min_n=sql.KM_MIN)


@result("logrank_terms", "V5", "SELECT * FROM lr_terms")
def _(s: Stages):
    return survival.logrank_terms(survival.duration_event(s.modeling_view), min_n=sql.KM_MIN)


@result("multivariate_logrank", "V5", "SELECT * FROM lr_test")
def _(s: Stages):
    return survival.multivariate_logrank(survival.duration_event(s.modeling_view), min_n=sql.KM_MIN)


# --- propensity -------------------------------------------------------------------------------------------------


@result("model_features", "M1", "SELECT * FROM feats")
def _(s: Stages):
    return propensity.model_features(s.modeling_view)


@result("collapse_rare", "M2", "SELECT * FROM feats_collapsed")
def _(s: Stages):
    return propensity.collapse_rare(propensity.model_features(s.modeling_view), min_count=sql.RARE)


@result(
    "temporal_split",
    "M3",
    f"SELECT social_id, cohort_month, label, CASE WHEN cohort_month < '{sql.CUTOFF}' THEN 'train' ELSE 'test' END AS parte FROM feats",
)
def _(s: Stages):
    train, test = propensity.temporal_split(propensity.model_features(s.modeling_view), sql.CUTOFF)
    tagged = lambda df, name: df.select("social_id", "cohort_month", "label", F.lit(name).alias("parte"))
    return tagged(train, "train").unionByName(tagged(test, "test"))


@result(
    "train_sample",
    "M4",
    "SELECT social_id, cohort_month, label FROM training ORDER BY md5('42:' || social_id), social_id LIMIT 400",
)
def _(s: Stages):
    train, _ = s.model_split
    return propensity.train_sample(train, 400).select("social_id", "cohort_month", "label")


_CELLS = " UNION ALL ".join(
    [
        f"""SELECT social_id, '{c}_' || {c} AS feature, 1.0::DOUBLE AS value FROM feats_collapsed
        WHERE {c} IS NOT NULL AND {c} <> (SELECT min({c}) FROM feats_collapsed)"""
        for c in sql.CATEGORIES
    ]
    + [f"SELECT social_id, '{c}', {c}::DOUBLE FROM feats_collapsed WHERE {c} <> 0" for c in sql.FLAGS]
    + [
        f"""SELECT social_id, '{c}', v FROM (SELECT social_id, ({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () > 0
            THEN stddev_pop({c}) OVER () ELSE 1 END) AS v FROM feats_collapsed) WHERE v <> 0"""
        for c in sql.NUMBERS
    ]
)


@result("design_matrix", "M5", _CELLS)
def _(s: Stages):
    return propensity.design_rows(propensity.design_matrix(s.model_rows), s.model_rows)


_TRAINED_NAMES = " UNION ALL ".join(
    [f"SELECT '{c}_' || v AS feature FROM (SELECT DISTINCT {c} AS v FROM training) WHERE v > (SELECT min({c}) FROM training)" for c in sql.CATEGORIES]
    + [f"SELECT '{c}'" for c in (*sql.FLAGS, *sql.NUMBERS)]
)


@result("logistic_l2", "M6", f"SELECT feature, 0::DOUBLE AS gradient FROM ({_TRAINED_NAMES})")
def _(s: Stages):
    train = s.model_split[0]
    slopes = propensity.logistic_gradient(propensity.logistic_l2(train), train)
    return slopes.select("feature", (F.round("gradient", 0) + F.lit(0.0)).alias("gradient"))


@result("bootstrap_ci", "M7", f"SELECT feature, true AS ordered, true AS share FROM ({_TRAINED_NAMES})")
def _(s: Stages):
    train = s.model_split[0]
    found = propensity.bootstrap_ci(train, propensity.logistic_l2(train), n=100)
    return found.select("feature", (F.col("or_low") <= F.col("or_high")).alias("ordered"), F.col("p_value").between(0.01, 1.0).alias("share"))


@result(
    "bootstrap_samples",
    "M7",
    """SELECT muestra, social_id FROM (
        SELECT m::INTEGER AS muestra, social_id, row_number() OVER (PARTITION BY m ORDER BY md5((1000 + m) || ':' || social_id), social_id) AS n
        FROM training, (SELECT unnest(range(0, 20)) AS m)) WHERE n <= 400""",
)
def _(s: Stages):
    return propensity.bootstrap_samples(s.model_split[0], n=20, size=400)


def _descent(source: str, steps: int) -> str:
    """Coefficients of the L2 fit on the scaled numbers for each draw ``m`` of ``source`` (m, y, x1, ...), by plain gradient steps."""
    xs = range(1, len(sql.NUMBERS) + 1)
    names = ", ".join(f"b{i}" for i in (0, *xs))
    line = " + ".join(["b0", *[f"b{i} * x{i}" for i in xs]])
    pulls = ", ".join(["sum(e) AS g0", *[f"sum(e * x{i}) AS g{i}" for i in xs]])
    moved = ", ".join(["b0 - pace * g0", *[f"b{i} - pace * (g{i} + b{i})" for i in xs]])
    zero = ", ".join(["0::DOUBLE" for _ in (0, *xs)])
    features, betas = ", ".join(f"'{c}'" for c in sql.NUMBERS), ", ".join(f"b{i}" for i in xs)
    return f"""
    draws AS MATERIALIZED ({source}), paces AS (SELECT m, 1 / (count(*) * 0.75 + 1) AS pace FROM draws GROUP BY m),
    descent(m, k, {names}) AS (
        SELECT m, 0, {zero} FROM paces
        UNION ALL
        SELECT m, k + 1, {moved} FROM (
            SELECT m, k, {names}, pace, {pulls} FROM (
                SELECT d.*, k, {names}, pace, 1 / (1 + exp(-({line}))) - y AS e FROM descent JOIN draws d USING (m) JOIN paces USING (m))
            GROUP BY m, k, {names}, pace) WHERE k < {steps}),
    fitted AS (SELECT m, unnest([{features}]) AS feature, unnest([{betas}]) AS beta FROM descent WHERE k = {steps})"""


_SCALED = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS x{i}" for i, c in enumerate(sql.NUMBERS, 1))
_XS = ", ".join(f"x{i}" for i in range(1, len(sql.NUMBERS) + 1))
_SCALED_ROWS = f"SELECT social_id, label::DOUBLE AS y, {_SCALED} FROM training"
DRAWS, DRAWN = 100, 400
_DRAWN_ROWS = f"""SELECT m, y, {_XS} FROM (
        SELECT *, row_number() OVER (PARTITION BY m ORDER BY md5((1000 + m) || ':' || social_id), social_id) AS n
        FROM scaled, (SELECT unnest(range(0, {DRAWS})) AS m)) WHERE n <= {DRAWN}"""


@result(
    "logistic_report",
    "M6",
    f"""SELECT * FROM (WITH RECURSIVE {_descent(f"SELECT 0 AS m, y, {_XS} FROM ({_SCALED_ROWS})", 1500)}
    SELECT feature, round(beta, 4) + 0 AS coef, round(exp(beta), 4) + 0 AS odds_ratio FROM fitted)""",
)
def _(s: Stages):
    """Coefficients and odds ratios of the fit on the scaled numbers."""
    train = s.model_split[0]
    fit = propensity.logistic_l2(train, design=propensity.design_matrix(train, (), ()))
    return propensity.odds_ratios(s.store.spark, fit).select("feature", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("coef", "odds_ratio")])


@result(
    "bootstrap_report",
    "M7",
    f"""SELECT * FROM (WITH RECURSIVE scaled AS MATERIALIZED ({_SCALED_ROWS}), {_descent(_DRAWN_ROWS, 600)}
    SELECT feature, round(exp(quantile_cont(beta, 0.025)), 4) + 0 AS or_low, round(exp(quantile_cont(beta, 0.975)), 4) + 0 AS or_high,
        least(1, greatest(2 * least(avg((beta > 0)::INTEGER), avg((beta < 0)::INTEGER)), 1 / {DRAWS})) AS p_value FROM fitted GROUP BY feature)""",
)
def _(s: Stages):
    """Intervals of the odds ratios over a hundred fits on draws, all in one solver."""
    train = s.model_split[0]
    design = propensity.design_matrix(train, (), ())
    fits = bootstrap_fits(propensity.fit_rows(design, train), design.names, DRAWS, DRAWN)
    ends = [(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("or_low", "or_high")]
    return propensity.bootstrap_interval(fits, DRAWS).select("feature", *ends, "p_value")


@result(
    "bootstrap_interval",
    "M7",
    """SELECT c_mktsegment AS feature, exp(quantile_cont(b, 0.025)) AS or_low, exp(quantile_cont(b, 0.975)) AS or_high,
        least(1, greatest(2 * least(avg((b > 0)::INTEGER), avg((b < 0)::INTEGER)), 1 / 500)) AS p_value
    FROM (SELECT c_mktsegment, c_acctbal::DOUBLE / 10000 AS b FROM customer) GROUP BY c_mktsegment""",
)
def _(s: Stages):
    rows = s.src.table("customer").select(
        F.col("c_custkey").alias("muestra"), F.col("c_mktsegment").alias("feature"), (F.col("c_acctbal").cast("double") / 10000).alias("beta")
    )
    return propensity.bootstrap_interval(rows, 500)


@result("boosted_trees", "M8", "SELECT social_id, label, true AS inside, true AS better FROM training")
def _(s: Stages):
    scored = propensity.predict(s.booster.model, s.model_split[0])
    area = evaluation.roc_auc(scored).select("roc_auc").scalar()
    return scored.select("social_id", "label", F.col("score").between(0, 1).alias("inside"), (area > 0.5).alias("better"))


@result("logistic_score", "M9", f"SELECT social_id, label, {sql.score_expression()} AS score FROM feats")
def _(s: Stages):
    return s.scored.select("social_id", "label", "score")


@result(
    "roc_auc",
    "M10",
    "SELECT sum(pos * (q - cum_neg + neg / 2)) / max(p::DOUBLE * q) AS roc_auc, sum(pos)::DOUBLE / sum(pos + neg) AS base_rate FROM score_steps",
)
def _(s: Stages):
    return evaluation.roc_auc(s.rounded_scores)


@result(
    "roc_curve",
    "M10",
    """SELECT 0::BIGINT AS puesto, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr
    UNION ALL SELECT puesto, cum_neg / q, cum_pos / p FROM score_steps
    WHERE puesto % (SELECT greatest(1, (count(*) + 1) // 200) FROM score_steps) = 0""",
)
def _(s: Stages):
    return evaluation.roc_curve(s.rounded_scores)


@result(
    "average_precision",
    "M11",
    "SELECT sum(pos * (cum_pos / (cum_pos + cum_neg))) / sum(pos) AS pr_auc FROM score_steps",
)
def _(s: Stages):
    return evaluation.average_precision(s.rounded_scores)


@result(
    "decile_lift",
    "M12",
    """SELECT decile, count(*) AS n, avg(label) AS rate, avg(score) AS avg_score FROM (
        SELECT *, greatest(0, ceil((r - 1) * 10 / (n - 1)) - 1)::INTEGER AS decile FROM (
            SELECT *, row_number() OVER (ORDER BY score, md5('0:' || social_id), social_id) AS r, count(*) OVER () AS n FROM scored))
    GROUP BY decile""",
)
def _(s: Stages):
    return evaluation.decile_lift(s.rounded_scores, "social_id")


@result(
    "calibration",
    "M13",
    """SELECT bin, count(*) AS n, avg(label) AS obs_rate, avg(score) AS avg_pred FROM (
        SELECT *, greatest(ceil(round(score * 10, 9)) - 1, 0)::INTEGER AS bin FROM scored) GROUP BY bin""",
)
def _(s: Stages):
    return evaluation.calibration(s.rounded_scores)


_given_score = propensity.Additive(sql.COEFFICIENTS, sql.INTERCEPT)


@result("permutation_importance", "M14", sql.permutation_statement(repeats=5))
def _(s: Stages):
    return propensity.permutation_importance(_given_score, s.model_split[1])


@result("partial_dependence", "M15", sql.dependence_statement("n_transacciones_trip1"))
def _(s: Stages):
    return propensity.partial_dependence(_given_score, s.model_split[0], "n_transacciones_trip1")


@result("save_load_model", "M16", "SELECT social_id, true AS same FROM testing")
def _(s: Stages):
    path = f"{s.store.root}/saved"
    propensity.save_model(s.store.spark, s.booster, path)
    again = propensity.load_model(s.store.spark, path)
    own = propensity.predict(s.booster.model, s.model_split[1]).select("social_id", "score")
    read = propensity.predict(again.model, s.model_split[1]).select("social_id", F.col("score").alias("again"))
    kept = again.importance == s.booster.importance and again.levels == s.booster.levels
    return own.join(read, "social_id").select("social_id", ((F.abs(F.col("score") - F.col("again")) < 1e-9) & F.lit(kept)).alias("same"))


# --- scoring ----------------------------------------------------------------------------------------------------


@result(
    "load_audience",
    "R1",
    """SELECT social_id, rebuy_ever FROM audience WHERE NOT rebuy_ever
        AND social_id IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal >= 0)""",
)
def _(s: Stages):
    ids = s.src.table("customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("social_id"))
    return actions.load_audience(s.modeling_view, ids, only_non_repeaters=True).select("social_id", "rebuy_ever")


_KNOWN = ", ".join(
    f"""CASE WHEN {c} IN (SELECT {c} FROM training) THEN {c}
        WHEN 'Otros' IN (SELECT {c} FROM training) THEN 'Otros' END AS {c}"""
    for c in sql.CATEGORIES
)
_TRAIN_MEDIAN = sql.quantile("training", "antiguedad_usuario_dias_al_trip1", 0.5)
_SCORE_FEATURES = f"""SELECT social_id, {_KNOWN}, {', '.join(sql.FLAGS)}, {', '.join(c for c in sql.NUMBERS)} FROM (
        {sql.features('audience', _TRAIN_MEDIAN)} FROM audience)"""


@result(
    "score_features",
    "R2",
    _SCORE_FEATURES,
)
def _(s: Stages):
    train, _ = s.model_split
    rows = actions.score_features(
        actions.load_audience(s.modeling_view),
        propensity.category_levels(train),
        propensity.account_age_median(train),
    )
    return rows.select("social_id", *propensity.FEATURES)


@result(
    "score_and_segment",
    "R3",
    "SELECT social_id, p_rebuy_18m, segmento FROM audience_out",
)
def _(s: Stages):
    return actions.score_and_segment(s.audience_scored).select("social_id", "p_rebuy_18m", "segmento")


@result("next_best_levers", "R4", "SELECT * FROM actions")
def _(s: Stages):
    return actions.next_best_levers(s.audience_scored, sql.IMPORTANCE).select(
        "social_id", "palanca_1", "accion_1", "palanca_2", "accion_2"
    )


@result("cross_sell", "R5", f"SELECT social_id, purchase_type, {sql.CROSS_SQL} AS producto_sugerido FROM audience")
def _(s: Stages):
    return actions.load_audience(s.modeling_view).select(
        "social_id", "purchase_type", actions.cross_sell("purchase_type").alias("producto_sugerido")
    )


@result("audience_table", "R6", "SELECT * FROM audience_out")
def _(s: Stages):
    return actions.audience_table(s.audience_scored, sql.IMPORTANCE)


@result(
    "score_audience",
    "R6",
    f"""SELECT a.social_id, a.pais, a.purchase_type AS purchase_type_t1, a.cohort_year, a.rebuy_ever, round_even(f.score, 4) AS p_rebuy_18m,
        CASE WHEN f.score >= 0.35 THEN 'alto' WHEN f.score >= 0.20 THEN 'medio' ELSE 'bajo' END AS segmento,
        x.palanca_1, x.accion_1, x.palanca_2, x.accion_2, a.producto_sugerido
    FROM (SELECT social_id, {sql.score_expression()} AS score FROM ({_SCORE_FEATURES})) f
    JOIN (SELECT *, {sql.CROSS_SQL} AS producto_sugerido FROM audience) a ON a.social_id = f.social_id JOIN actions x ON x.social_id = f.social_id""",
)
def _(s: Stages):
    given = lambda rows: rows.withColumn("score", propensity.logistic_score(sql.COEFFICIENTS, sql.INTERCEPT))
    return actions.score_audience(s.modeling_view, replace(s.booster, importance=sql.IMPORTANCE), score=given)


@result(
    "segment_summary",
    "R7",
    """SELECT 'general' AS medida, NULL AS valor, count(*) AS n, avg(p_rebuy_18m) AS media, median(p_rebuy_18m) AS mediana FROM audience_out
    UNION ALL SELECT 'segmento', segmento, count(*), avg(p_rebuy_18m), NULL FROM audience_out GROUP BY segmento
    UNION ALL SELECT 'palanca_1', palanca_1, count(*), NULL, NULL FROM audience_out GROUP BY palanca_1""",
)
def _(s: Stages):
    return actions.segment_summary(actions.audience_table(s.audience_scored, sql.IMPORTANCE))


# --- neighbours -------------------------------------------------------------------------------------------------


@result(
    "split_reference_target",
    "K1",
    "SELECT social_id, 'referencia' AS grupo FROM kref UNION ALL SELECT social_id, 'objetivo' FROM kask",
)
def _(s: Stages):
    reference, target = s.knn_groups
    tagged = lambda df, name: df.select("social_id", F.lit(name).alias("grupo"))
    return tagged(reference, "referencia").unionByName(tagged(target, "objetivo"))


@result(
    "encode_mixed_features",
    "K2",
    " UNION ALL ".join(
        [f"SELECT id, '{c}' AS feature, {c} AS value FROM kask_points" for c in sql.KNN_AXES]
        + [
            f"SELECT id, '{c}=' || {c}, 1.0::DOUBLE FROM kask_points WHERE {c} IN (SELECT {c} FROM kref_points)"
            for c in sql.KNN_NOMINALS
        ]
    ),
)
def _(s: Stages):
    reference, target = s.knn_groups
    return neighbours.encode_mixed_features(target, reference)


@result(
    "unknown_levels",
    "K2",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, {c} AS valor, count(*) AS n FROM ku
        WHERE {c} IS NOT NULL AND NOT list_contains({levels!r}, {c}) GROUP BY {c}"""
        for c, levels in sql.KNN_ORDINALS.items()
    ),
)
def _(s: Stages):
    return neighbours.unknown_levels(s.knn_users)


@result(
    "standardise_on_reference",
    "K3",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS scale FROM kref_points"
        for c in sql.KNN_AXES
    )
    + " UNION ALL SELECT variable || '=' || nivel, share, CASE WHEN share < 1 THEN sqrt(share * (1 - share)) ELSE 1 END FROM klevels",
)
def _(s: Stages):
    return neighbours.standardise_on_reference(s.knn_groups[0])


@result("knn_join", "K4", "SELECT * FROM knn")
def _(s: Stages):
    return s.build_neighbours()


@result(
    "weighted_mode",
    "K5",
    """SELECT social_id, producto_recomendado, destino_recomendado, tipo_destino_recomendado FROM recommended""",
)
def _(s: Stages):
    rows = neighbours.with_outcomes(s.neighbours, s.knn_groups[0], neighbours.VOTES)
    names = ("producto_recomendado", "destino_recomendado", "tipo_destino_recomendado")
    return rows.select(
        F.col("id").alias("social_id"),
        *[neighbours.weighted_mode("vecinos", c).alias(n) for c, n in zip(neighbours.VOTES, names)],
    )


@result(
    "weighted_mean", "K6", "SELECT social_id, dias_anticipacion_compra_2, dias_checkout_a_compra_2 FROM recommended"
)
def _(s: Stages):
    rows = neighbours.with_outcomes(
        s.neighbours, neighbours.days_checkout_to_next(s.knn_groups[0]), neighbours.DAYS
    )
    return rows.select(
        F.col("id").alias("social_id"), *[neighbours.weighted_mean("vecinos", c).alias(c) for c in neighbours.DAYS]
    )


@result("neighbour_agreement", "K7", "SELECT social_id, producto_recomendado, confianza FROM recommended")
def _(s: Stages):
    rows = neighbours.with_outcomes(s.neighbours, s.knn_groups[0], ["productos_trip_2"])
    product = neighbours.weighted_mode("vecinos", "productos_trip_2")
    return rows.select(
        F.col("id").alias("social_id"),
        product.alias("producto_recomendado"),
        neighbours.agreement("vecinos", "productos_trip_2", product).alias("confianza"),
    )


@result(
    "days_checkout_to_next",
    "K8",
    """SELECT social_id, dias_checkout_a_compra_2, (trip_checkout::DATE + dias_checkout_a_compra_2) AS fecha_comunicar FROM kref""",
)
def _(s: Stages):
    rows = neighbours.days_checkout_to_next(s.knn_groups[0])
    return rows.select(
        "social_id",
        "dias_checkout_a_compra_2",
        neighbours.contact_date("trip_checkout", "dias_checkout_a_compra_2").alias("fecha_comunicar"),
    )


@result("knn_table", "K9", "SELECT * FROM kt")
def _(s: Stages):
    return s.build_knn_table()


_SHARE = """SELECT * FROM (SELECT '{report}' AS reporte, {c} AS valor, round_even(count(*) / (SELECT count(*) FROM kt) * 100, 1) AS cifra
    FROM kt WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT {n})"""


@result(
    "recommendation_summary",
    "K10",
    _SHARE.format(report="producto", c="producto_recomendado", n=8)
    + " UNION ALL "
    + _SHARE.format(report="tipo_destino", c="tipo_destino_recomendado", n=10)
    + """ UNION ALL SELECT 'confianza', v, round_even(c, 2) FROM (SELECT producto_recomendado AS v, round(avg(confianza), 9) AS c FROM kt
        WHERE producto_recomendado IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)""",
)
def _(s: Stages):
    return neighbours.recommendation_summary(s.knn_table)


@result(
    "knn_median_variant",
    "K11",
    """SELECT a.social_id, pais, tipo_viaje, product_type, destino_trip, rango_edad_primer_trip, income, gross_bookings_usd,
        p.v AS producto_recomendado_trip2, round_even(k.distancia, 3) AS distancia_vecino_mas_cercano, c.v AS confianza
    FROM mask a JOIN (SELECT * FROM mknn WHERE puesto = 1) k ON a.social_id = k.id JOIN mvote p ON a.social_id = p.id
    JOIN (SELECT n.id, round_even(count(*) FILTER (n.productos_trip_2 = m.v) / count(*), 2) AS v FROM mvotes n JOIN mvote m ON n.id = m.id GROUP BY n.id) c
        ON a.social_id = c.id""",
)
def _(s: Stages):
    return neighbours.knn_median_variant(s.modeling_view)


@result(
    "lsh_recall",
    "K4",
    """SELECT 'todos' AS grupo, count(DISTINCT id) AS n, count(*) AS pares, true AS alcanza FROM knn
    UNION ALL SELECT 'centena', count(DISTINCT id), count(*), true FROM knn WHERE id::BIGINT % 100 = 0 HAVING count(*) > 0""",
)
def _(s: Stages):
    """Whether the hashed join finds nine in ten of the exact neighbours, over all targets and over ids divisible by 100."""
    reference, target = s.knn_groups
    near = written(lsh.approximate_users(target, reference), "lsh-neighbours")
    hundredth = F.col("id").cast("long") % 100 == 0
    parts = [("todos", near, s.neighbours), ("centena", near.filter(hundredth), s.neighbours.filter(hundredth))]
    shares = [lsh.recall(got, exact).withColumn("grupo", F.lit(name)) for name, got, exact in parts]
    rows = shares[0].unionByName(shares[1]).filter("n > 0")
    return rows.select("grupo", "n", "pares", (F.col("recall") >= 0.9).alias("alcanza"))


# --- mart -------------------------------------------------------------------------------------------------------


@result("main_product", "B1", "SELECT social_id, producto_recomendado, producto_main FROM mart")
def _(s: Stages):
    return mart.mart_rows(s.knn_table).select("social_id", "producto_recomendado", "producto_main")


@result(
    "dictionary_encode",
    "B2",
    """SELECT social_id, pais, (dense_rank() OVER (ORDER BY coalesce(pais, 'Sin dato')) - 1)::INTEGER AS pais_code,
        (coalesce(list_position(['Sin dato','<18','18-24','25-34','35-44','45-54','55-64','65+','Edad invalida'], rango_edad_primer_trip), 1) - 1)::INTEGER AS edad_code,
        (coalesce(list_position(['Unknown','Low','Medium','High'], income), 0) - 1)::INTEGER AS income_code FROM mart""",
)
def _(s: Stages):
    rows = mart.dictionary_encode(mart.mart_rows(s.knn_table), "pais", "pais_code")
    return rows.select(
        "social_id",
        "pais",
        "pais_code",
        mart.ordered_code("rango_edad_primer_trip", mart.AGE_ORDER).alias("edad_code"),
        mart.ordered_code("income", mart.INCOME_ORDER).alias("income_code"),
    )


@result(
    "dominant_type_per_code",
    "B3",
    "SELECT 'destino' AS lugar, * FROM dominant_destination UNION ALL SELECT 'origen', * FROM dominant_origin",
)
def _(s: Stages):
    rows = mart.mart_rows(s.knn_table)
    parts = {
        "destino": mart.dominant_type_per_code(rows, "destino_recomendado", "tipo_destino_recomendado", "SIN_DATO"),
        "origen": mart.dominant_type_per_code(rows, "origen_trip", "tipo_origen", "Sin dato"),
    }
    tagged = [df.select(F.lit(k).alias("lugar"), "valor", "tipo", "n") for k, df in parts.items()]
    return tagged[0].unionByName(tagged[1])


@result("origin_type", "B4", "SELECT social_id, origen_trip, tipo_origen FROM mart")
def _(s: Stages):
    return mart.mart_rows(s.knn_table).select("social_id", "origen_trip", "tipo_origen")


@result("pack_numeric", "B5", "SELECT * FROM packed")
def _(s: Stages):
    return mart.pack_numeric(s.knn_table, EPOCH)


def _code(dimension: str, value: str) -> str:
    return f"(SELECT codigo FROM mart_dims d WHERE d.dimension = '{dimension}' AND d.valor = {value})"


@result(
    "recommendation_mart",
    "B6",
    f"""SELECT p.*, {_code('pais', "coalesce(m.pais, 'Sin dato')")} AS pais, {_code('tipo_viaje', "coalesce(m.tipo_viaje, 'Sin dato')")} AS tipo_viaje,
        {_code('producto', 'm.producto_main')} AS producto, {_code('destino', "coalesce(m.destino_recomendado, 'SIN_DATO')")} AS destino,
        {_code('origen', 'm.origen_trip')} AS origen,
        (coalesce(list_position(['Unknown','Low','Medium','High'], income), 0) - 1)::INTEGER AS income,
        (coalesce(list_position(['Sin dato','<18','18-24','25-34','35-44','45-54','55-64','65+','Edad invalida'], rango_edad_primer_trip), 1) - 1)::INTEGER AS edad
    FROM mart m JOIN packed p ON m.social_id = p.social_id""",
)
def _(s: Stages):
    return mart.mart_fact(s.knn_table, EPOCH)


@result(
    "mart_dictionaries",
    "B6",
    """SELECT d.dimension, codigo, d.valor, CASE d.dimension WHEN 'destino' THEN t.tipo WHEN 'origen' THEN o.tipo END AS tipo
    FROM mart_dims d LEFT JOIN dominant_destination t ON d.dimension = 'destino' AND d.valor = t.valor
    LEFT JOIN dominant_origin o ON d.dimension = 'origen' AND d.valor = o.valor
    UNION ALL SELECT 'income', (i - 1)::INTEGER, ['Unknown','Low','Medium','High'][i], NULL FROM range(1, 5) r(i)
    UNION ALL SELECT 'edad', (i - 1)::INTEGER, ['Sin dato','<18','18-24','25-34','35-44','45-54','55-64','65+','Edad invalida'][i], NULL FROM range(1, 10) r(i)""",
)
def _(s: Stages):
    return mart.mart_dictionaries(s.knn_table)


@result(
    "mart_summary",
    "B6",
    """SELECT count(*) AS total_usuarios, count(DISTINCT coalesce(destino_recomendado, 'SIN_DATO')) AS destinos,
        count(DISTINCT origen_trip) AS origenes, count(DISTINCT fecha_comunicar) AS dias FROM mart""",
)
def _(s: Stages):
    return mart.mart_summary(s.knn_table)


# --- quality ----------------------------------------------------------------------------------------------------


@result(
    "null_share_by_group",
    "Q1",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, true AS existe, 100 * avg(({c} IS NULL)::INTEGER) FILTER (tipo_usuario = '1 trip') AS pct_nulos_a,
            100 * avg(({c} IS NULL)::INTEGER) FILTER (tipo_usuario = '2 o mas trips') AS pct_nulos_b FROM user_grain"""
        for c in quality.KEY_FEATURES
    ),
)
def _(s: Stages):
    return quality.null_share_by_group(s.user_grain)


_G = "gross_bookings_usd"


@result(
    "money_profile",
    "Q2",
    f"""SELECT unnest(['min','max','n_ceros','pct_ceros','n_negativos','pct_negativos','n_mayores','pct_mayores','p1','p25','p50','p75','p95','p99']) AS medida,
        unnest([min({_G}), max({_G}), count(*) FILTER ({_G} = 0)::DOUBLE, 100 * avg(({_G} = 0)::INTEGER), count(*) FILTER ({_G} < 0)::DOUBLE,
            100 * avg(({_G} < 0)::INTEGER), count(*) FILTER ({_G} > 10000)::DOUBLE, 100 * avg(({_G} > 10000)::INTEGER),
            quantile_cont({_G}, 0.01), quantile_cont({_G}, 0.25), quantile_cont({_G}, 0.5), quantile_cont({_G}, 0.75),
            quantile_cont({_G}, 0.95), quantile_cont({_G}, 0.99)]) AS valor
    FROM user_grain WHERE {_G} IS NOT NULL""",
)
def _(s: Stages):
    return quality.money_profile(s.user_grain)


@result(
    "cardinality_top5",
    "Q3",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS variable, (count(*) OVER ())::BIGINT AS n_unicos,
            row_number() OVER (ORDER BY n DESC, {c})::INTEGER AS puesto, {c} AS valor, 100 * n / (sum(n) OVER ()) AS pct
        FROM (SELECT {c}, count(*) AS n FROM user_grain WHERE {c} IS NOT NULL AND {where} GROUP BY {c})) WHERE puesto <= 5"""
        for c, where in (("destino_trip", "true"), ("destino_trip_2", "tipo_usuario = '2 o mas trips'"))
    ),
)
def _(s: Stages):
    return quality.cardinality_top5(s.user_grain)


@result(
    "lookup_coverage",
    "Q4",
    """SELECT 'cobertura' AS reporte, NULL AS valor, 100 * avg((grupo <> 'OTRO')::INTEGER) AS cifra FROM coverage_rows
    UNION ALL SELECT * FROM (SELECT 'grupo', grupo, count(*)::DOUBLE AS n FROM coverage_rows GROUP BY grupo ORDER BY n DESC, grupo LIMIT 12)
    UNION ALL SELECT * FROM (SELECT 'sin_mapear', codigo, count(*)::DOUBLE AS n FROM coverage_rows
        WHERE grupo = 'OTRO' AND codigo IS NOT NULL GROUP BY codigo ORDER BY n DESC, codigo LIMIT 20)""",
)
def _(s: Stages):
    return quality.lookup_coverage(s.user_grain)


_CONSTANT = {
    "transaction_code": ("gross_bookings_usd", "flg_uso_cupon", "puntos_usados", "cantidad_interacciones_cs", "metodos_pago", "product_type"),
    "social_id": ("flg_app_90d_antes_trip1", "fecha_primer_trip", "fecha_segundo_trip", "tipo_usuario", "destino_trip"),
}


@result(
    "constancy_check",
    "Q5",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count(*) FILTER (n > 1) AS claves_inconsistentes, '{key}' AS clave
        FROM (SELECT count(DISTINCT {c}) AS n FROM wide GROUP BY {key})"""
        for key, columns in _CONSTANT.items()
        for c in columns
    ),
)
def _(s: Stages):
    parts = [quality.constancy_check(s.wide, key, columns) for key, columns in _CONSTANT.items()]
    return parts[0].unionByName(parts[1])


