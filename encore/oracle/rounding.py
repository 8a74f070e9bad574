"""Fractional columns of each result; both sides round them, so that summation order does not show."""

DOUBLES: dict[str, list[str]] = {
    "drifting_csv": ["c_acctbal"],
    "json_sink": ["c_acctbal"],
    "quantiles_without_nan": ["probability", "value"],
    "economics": [
        "gross_bookings_usd", "cost_usd", "margin_variable_without_mkt_net_usd", "net_revenues_usd", "npv_without_mkt_net_usd",
        "fee_net_usd",
    ],
    "trip2_features": ["gross_bookings_usd_2"],
    "loyalty_redemption": ["puntos_usados"],
    "customer_service": ["avg_agent_empathy_cs", "min_agent_empathy_cs", "max_agent_empathy_cs"],
    "payment_methods": [
        "gb_total_payments", "gb_tarjeta_credito", "gb_transferencia", "gb_deposito_bancario", "gb_puntos_loyalty", "gb_cupon",
        "gb_cash", "pct_gb_tarjeta_credito", "pct_gb_transferencia", "pct_gb_deposito_bancario", "pct_gb_puntos_loyalty",
        "pct_gb_cupon", "pct_gb_cash",
    ],
    "final_wide": [
        "gross_bookings_usd_2", "gross_bookings_usd", "cost_usd", "margin_variable_without_mkt_net_usd", "net_revenues_usd",
        "npv_without_mkt_net_usd", "fee_net_usd", "gb_total_payments", "gb_tarjeta_credito", "gb_transferencia",
        "gb_deposito_bancario", "gb_puntos_loyalty", "gb_cupon", "gb_cash", "pct_gb_tarjeta_credito", "pct_gb_transferencia",
        "pct_gb_deposito_bancario", "pct_gb_puntos_loyalty", "pct_gb_cupon", "pct_gb_cash", "avg_agent_empathy_cs",
        "min_agent_empathy_cs", "max_agent_empathy_cs", "puntos_usados",
    ],
    "wide_sample": [
        "gross_bookings_usd_2", "gross_bookings_usd", "cost_usd", "margin_variable_without_mkt_net_usd", "net_revenues_usd",
        "npv_without_mkt_net_usd", "fee_net_usd", "gb_total_payments", "gb_tarjeta_credito", "gb_transferencia",
        "gb_deposito_bancario", "gb_puntos_loyalty", "gb_cupon", "gb_cash", "pct_gb_tarjeta_credito", "pct_gb_transferencia",
        "pct_gb_deposito_bancario", "pct_gb_puntos_loyalty", "pct_gb_cupon", "pct_gb_cash", "avg_agent_empathy_cs",
        "min_agent_empathy_cs", "max_agent_empathy_cs", "puntos_usados",
    ],
    "user_grain_latest_file": ["gross_bookings_usd_2", "gross_bookings_usd"],
    "tx_level": [
        "puntos_usados", "gb_total_payments", "pct_gb_tarjeta_credito", "pct_gb_transferencia", "pct_gb_deposito_bancario",
        "pct_gb_puntos_loyalty", "pct_gb_cupon", "pct_gb_cash", "avg_agent_empathy_cs", "gross_bookings_usd", "cost_usd",
        "net_revenues_usd", "fee_net_usd", "margin_variable_usd", "npv_usd",
    ],
    "trip1_agg": [
        "puntos_usados", "gross_bookings_usd", "cost_usd", "margin_variable_usd", "net_revenues_usd", "npv_usd", "fee_net_usd",
        "gb_total_payments", "avg_agent_empathy_cs",
    ],
    "modeling_view": [
        "puntos_usados", "gross_bookings_usd", "cost_usd", "margin_variable_usd", "net_revenues_usd", "npv_usd", "fee_net_usd",
        "gb_total_payments", "avg_agent_empathy_cs",
    ],
    "seeded_sample": [
        "puntos_usados", "gross_bookings_usd", "cost_usd", "margin_variable_usd", "net_revenues_usd", "npv_usd", "fee_net_usd",
        "gb_total_payments", "avg_agent_empathy_cs",
    ],
    "impute_and_log": ["gross_bookings_usd_2", "gross_bookings_usd", "log_gb_usd"],
    "kpi_by_horizon": ["rate"],
    "kpi_overall": ["rate_ever", "mediana_dias_a_recompra", "promedio_dias_a_recompra"],
    "categorical_breakdown": ["rate"],
    "continuous_bins": ["rate", "avg_valor"],
    "distribution_by_target": ["p10", "p25", "p50", "p75", "p90", "media"],
    "two_way_interaction": ["rate"],
    "year_segments": ["rate"],
    "contamination_share": ["pct_contaminados"],
    "repeat_speed_buckets": ["avg_dias", "avg_visitas", "avg_searches"],
    "destination_season_loyalty": ["pct_mismo_destino", "pct_mismo_mes", "pct_mismo_trimestre"],
    "kaplan_meier": ["s"],
    "survival_on_grid": ["s"],
    "group_kaplan_meier": ["s"],
    "logrank_terms": ["esperado", "covarianza"],
    "multivariate_logrank": ["chi2", "p_value"],
    "model_features": ["log_gross_bookings", "visitas_app_90d_antes_trip1", "n_transacciones_trip1", "antiguedad_usuario_dias_al_trip1"],
    "collapse_rare": ["log_gross_bookings", "visitas_app_90d_antes_trip1", "n_transacciones_trip1", "antiguedad_usuario_dias_al_trip1"],
    "design_matrix": ["value"],
    "logistic_score": ["score"],
    "roc_auc": ["roc_auc", "base_rate"],
    "roc_curve": ["fpr", "tpr"],
    "average_precision": ["pr_auc"],
    "decile_lift": ["rate", "avg_score"],
    "calibration": ["obs_rate", "avg_pred"],
    "score_features": ["log_gross_bookings", "visitas_app_90d_antes_trip1", "n_transacciones_trip1", "antiguedad_usuario_dias_al_trip1"],
    "score_and_segment": ["p_rebuy_18m"],
    "audience_table": ["p_rebuy_18m"],
    "segment_summary": ["media", "mediana"],
    "encode_mixed_features": ["value"],
    "standardise_on_reference": ["mean", "scale"],
    "knn_join": ["distancia"],
    "weighted_mean": ["dias_anticipacion_compra_2", "dias_checkout_a_compra_2"],
    "neighbour_agreement": ["confianza"],
    "knn_table": ["confianza", "dias_anticipacion_compra_2", "dias_checkout_a_compra_2", "distancia_vecino_1", "gross_bookings_usd"],
    "recommendation_summary": ["cifra"],
    "knn_median_variant": ["gross_bookings_usd", "distancia_vecino_mas_cercano", "confianza"],
    "null_share_by_group": ["pct_nulos_a", "pct_nulos_b"],
    "money_profile": ["valor"],
    "cardinality_top5": ["pct"],
    "lookup_coverage": ["cifra"],
    "permutation_importance": ["importance"],
    "partial_dependence": ["grid", "avg_pred"],
    "logistic_l2": ["gradient"],
    "bootstrap_interval": ["or_low", "or_high", "p_value"],
    "score_audience": ["p_rebuy_18m"],
}
