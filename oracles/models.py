"""SQL for history features, scores, evaluation, watchlist and dashboard tables."""

from __future__ import annotations

from oracles.tables import BAND, ORACLES, oracle

NUMERIC = (
    "hist_num_observations", "hist_avg_uptime", "hist_min_uptime", "hist_avg_downtime",
    "hist_max_downtime", "hist_total_downtime", "hist_avg_outage_count",
    "hist_total_outage_count", "hist_avg_users_affected", "hist_pct_impactful",
)
MEANS = (
    "hist_avg_uptime", "hist_avg_downtime", "hist_avg_outage_count", "hist_avg_users_affected",
    "hist_pct_impactful",
)
MODES = "hist_mode_operator, hist_mode_state, hist_mode_network_type"
FEATURES = ", ".join(f"round({c}, 9) AS {c}" if c in MEANS else c for c in NUMERIC)

oracle("ml_obs_counts", "obs", """SELECT COUNT(*) FILTER (n >= 2) AS modelable_towers,
  COUNT(*) FILTER (n = 1) AS single_observation_towers
  FROM (SELECT COUNT(*) AS n FROM obs GROUP BY tower_id)""")
oracle("ml_history", "hist", f"SELECT row_id, tower_id, {FEATURES} FROM hist")
oracle("ml_history_mode", "hist", f"SELECT row_id, {MODES} FROM hist")
oracle("ml_history_city", "hist", "SELECT row_id, hist_city FROM hist")
oracle("ml_target", "hist", "SELECT row_id, tower_id, target_date, next_period_high_risk FROM hist")
oracle("ml_target_latest", "hist", """SELECT row_id, tower_id, hist_num_observations, target_date,
  next_period_high_risk FROM hist
  QUALIFY row_number() OVER (PARTITION BY tower_id ORDER BY target_date DESC, row_id DESC) = 1""")
oracle("sink_model_csv", "hist", f"""SELECT {FEATURES}, {MODES}, hist_city, tower_id, row_id, target_date,
  next_period_high_risk FROM hist""")
oracle("ml_dataset_stats", "hist", """SELECT hist_num_observations, COUNT(*) AS examples,
  SUM(next_period_high_risk)::BIGINT AS positives, round(AVG(next_period_high_risk), 9) AS base_rate,
  MIN(target_date) AS first_target, MAX(target_date) AS last_target FROM hist GROUP BY ALL""")
oracle("ml_time_split", "split", "SELECT row_id, target_date, split_date, is_test FROM split")
oracle("ml_split_stats", "split", """SELECT is_test, COUNT(*) AS rows, MIN(target_date) AS first_target,
  MAX(target_date) AS last_target, round(AVG(next_period_high_risk), 9) AS target_rate,
  MIN(split_date) AS split_date FROM split GROUP BY is_test""")
oracle("ml_scale", "split", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(AVG({c}::DOUBLE), 6) AS mean, round(stddev_pop({c}::DOUBLE), 6) AS std "
    "FROM split WHERE NOT is_test" for c in NUMERIC))
oracle("ml_class_weight", "split", """SELECT next_period_high_risk AS label, COUNT(*) AS n,
  (SUM(COUNT(*)) OVER ())::DOUBLE / (COUNT(*) OVER () * COUNT(*)) AS weight
  FROM split WHERE NOT is_test GROUP BY label""")

_LABELS = ("hist_mode_operator", "hist_mode_state", "hist_mode_network_type", "hist_city")
_SEEN = {
    c: f"(SELECT {c}, row_number() OVER (ORDER BY {c}) AS place FROM split WHERE NOT is_test GROUP BY {c})"
    for c in _LABELS
}
_JOINED = "FROM split " + " ".join(
    f"LEFT JOIN {_SEEN[c]} AS s_{c} ON s_{c}.{c} = split.{c}" for c in _LABELS) + " WHERE is_test"
oracle("ml_onehot", "split", "SELECT row_id, " + ", ".join(
    f"coalesce(s_{c}.place, 0) AS {c}_hot" for c in _LABELS) + f" {_JOINED}")
oracle("ml_assemble", "split", "SELECT row_id, (10 + " + " + ".join(
    f"(SELECT COUNT(*) FROM {_SEEN[c]})" for c in _LABELS) + ")::INT AS n_features, round(" + " + ".join(
    [f"split.{c}::DOUBLE" for c in NUMERIC]
    + [f"CASE WHEN s_{c}.place IS NULL THEN 0 ELSE 1 END" for c in _LABELS]
) + f", 6) AS total {_JOINED}")

_CELLS = """SELECT COUNT(*) FILTER (label = 1 AND p > 0.5)::DOUBLE AS tp,
  COUNT(*) FILTER (label = 0 AND p > 0.5)::DOUBLE AS fp, COUNT(*) FILTER (label = 1 AND p <= 0.5)::DOUBLE AS fn,
  COUNT(*) FILTER (label = 0 AND p <= 0.5)::DOUBLE AS tn FROM pred"""
oracle("ml_metrics", "pred", f"""SELECT round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
  round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM ({_CELLS})""")
# Area under the curve by average ranks.
oracle("ml_auc", "pred", """SELECT round((SUM(r) FILTER (label = 1)
    - COUNT(*) FILTER (label = 1) * (COUNT(*) FILTER (label = 1) + 1) / 2::DOUBLE)
    / (COUNT(*) FILTER (label = 1)::DOUBLE * COUNT(*) FILTER (label = 0)), 9) AS roc_auc
  FROM (SELECT label, rank() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2::DOUBLE AS r FROM pred)""")
oracle("ml_confusion", "pred", """SELECT a::INT AS actual, b::INT AS predicted, COUNT(row_id) AS n
  FROM (VALUES (0), (1)) x(a) CROSS JOIN (VALUES (0), (1)) y(b)
  LEFT JOIN pred ON label = a AND (p > 0.5)::INT = b GROUP BY a, b""")
oracle("ml_roc_points", "pred", """SELECT DISTINCT p AS threshold,
  (COUNT(*) FILTER (label = 0) OVER (ORDER BY p DESC))::DOUBLE / (COUNT(*) FILTER (label = 0) OVER ()) AS fpr,
  (COUNT(*) FILTER (label = 1) OVER (ORDER BY p DESC))::DOUBLE / (COUNT(*) FILTER (label = 1) OVER ()) AS tpr
  FROM pred""")

_RATES = ", ".join(f"round({c}, 9) AS {c}" for c in (
    "avg_uptime_percentage", "avg_downtime_minutes", "avg_outage_count", "avg_users_affected",
    "pct_impactful"))
oracle("score_rates", "rate", f"SELECT tower_id, {_RATES}, total_observations FROM rate")
oracle("score_minmax", "comp", "SELECT tower_id, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("norm_downtime_risk", "norm_uptime_risk", "norm_impact_risk",
                                      "norm_frequency_risk")) + " FROM comp")
_SCORE = "round(site_reliability_risk_score, 6) AS site_reliability_risk_score"
oracle("score_weighted", "score", f"SELECT tower_id, {_SCORE} FROM score")
oracle("score_category", "final", "SELECT tower_id, risk_category_final FROM final")
oracle("score_dist", "final", """SELECT risk_category_final, COUNT(*) AS n, round(any_value(q1), 6) AS q1,
  round(any_value(q2), 6) AS q2, round(any_value(q3), 6) AS q3 FROM final, qs GROUP BY risk_category_final""")
oracle("score_bias", "score", """SELECT total_observations > 1 AS is_multi_obs, COUNT(*) AS towers,
  round(AVG(site_reliability_risk_score), 6) AS avg_score FROM score GROUP BY 1""")
oracle("wl_full_history", "full_", f"""SELECT tower_id, {FEATURES}, {MODES}, hist_city, latest_uptime,
  latest_date FROM full_""")
oracle("wl_prob_band", "pred", f"SELECT row_id, p, {BAND.format('p')} AS predicted_risk_category FROM pred")
oracle("wl_merge", "watch", f"""SELECT tower_id, predicted_risk_probability, predicted_risk_category, {_SCORE},
  risk_category_final FROM watch""")
oracle("wl_priority", "watch", "SELECT tower_id, recommended_priority FROM watch")
oracle("wl_priority_rows", "pred", """SELECT row_id,
  row_number() OVER (ORDER BY p DESC, label DESC, row_id) AS recommended_priority FROM pred""")
oracle("sink_watchlist_csv", "watch", f"SELECT * REPLACE ({_SCORE.split(' AS ')[0]} AS site_reliability_risk_score) FROM watch")
oracle("wl_validate", "obs", """SELECT COUNT(DISTINCT tower_id) AS listed_rows,
  COUNT(DISTINCT tower_id) AS listed_towers, COUNT(DISTINCT tower_id) AS towers, TRUE AS covers_all,
  TRUE AS key_unique FROM obs""")

# --- dashboard
oracle("dash_legends", "leg", "SELECT dimension, code, value FROM leg")


def _code(dimension: str, value: str) -> str:
    return f"(SELECT code FROM leg WHERE dimension = '{dimension}' AND leg.value = {value})"


def _even(units: str, step: int) -> str:
    """Whole ``units`` divided by ``step``, rounded half to even."""
    q, r = f"({units}) // {step}", f"({units}) % {step}"
    return f"({q} + CASE WHEN 2 * ({r}) > {step} OR (2 * ({r}) = {step} AND ({q}) % 2 = 1) THEN 1 ELSE 0 END)"


_UP, _DOWN = "CAST(uptime_percentage * 100 AS BIGINT)", "CAST(downtime_minutes * 100 AS BIGINT)"
oracle("dash_obs_cube", "obs leg", f"""SELECT row_id,
  {_code('dates', "strftime(obs_date, '%Y-%m-%d')")} AS d, {_code('operators', 'operator')} AS op,
  {_code('networks', 'network_type')} AS nt, {_code('states', 'state')} AS st, {_code('cities', 'city')} AS ct,
  {_code('reasons', "coalesce(outage_reason, 'None')")} AS rs,
  {_even(_UP, 10)}::INT AS up, {_even(_DOWN, 10)}::INT AS dt, outage_count AS oc, avg_users_affected AS ua
  FROM obs""")
_BOARD = """SELECT * FROM tw WHERE tower_id IN (
    (SELECT tower_id FROM tw ORDER BY avg_uptime_percentage, tower_id LIMIT 400)
    UNION (SELECT tower_id FROM tw WHERE repeat_outage_indicator = 1
           ORDER BY impactful_outage_observations DESC, tower_id LIMIT 400))"""
oracle("dash_worst_repeat", "tw", f"SELECT tower_id FROM ({_BOARD})")
oracle("dash_tower_table", "tw leg", f"""SELECT tower_id AS id, {_code('cities', 'city')} AS ct,
  {_code('operators', 'mode_operator')} AS op, {_code('states', 'mode_state')} AS st,
  {_code('networks', 'mode_network_type')} AS nt, total_observations AS obs,
  CAST(round(avg_uptime_percentage * 100) AS INT) AS up,
  {_even('CAST(round(total_downtime_minutes * 100) AS BIGINT)', 100)}::BIGINT AS dtot,
  total_users_affected AS utot, impactful_outage_observations AS impc, repeat_outage_indicator AS rep
  FROM ({_BOARD})""")
oracle("dash_tower_stats", "tw", """SELECT COUNT(*) AS total_towers,
  COUNT(*) FILTER (repeat_outage_indicator = 1) AS repeat_outage_towers FROM tw""")
oracle("dash_watch_top", "watch leg", f"""SELECT tower_id AS id, {_code('operators', 'operator')} AS op,
  {_code('states', 'state')} AS st, {_code('cities', 'city')} AS ct, {_code('networks', 'network_type')} AS nt,
  CAST(round(latest_uptime * 100) AS INT) AS lu,
  {_even('CAST(round(historical_total_downtime_minutes * 100) AS BIGINT)', 100)}::BIGINT AS td,
  historical_total_outage_count AS to, round_even(site_reliability_risk_score, 1) AS score,
  risk_category_final AS rc, CAST(round(predicted_risk_probability * 10000) AS INT) AS prob,
  predicted_risk_category AS pc, recommended_priority AS pri
  FROM watch ORDER BY recommended_priority LIMIT 500""")
oracle("dash_watch_stats", "watch", """SELECT COUNT(*) AS total_towers,
  COUNT(*) FILTER (predicted_risk_category IN ('High', 'Critical')) AS predicted_high_or_critical,
  round(AVG(predicted_risk_probability), 4) AS avg_predicted_probability, """ + ", ".join(
    f"COUNT(*) FILTER (risk_category_final = '{c} Risk') AS {c.lower()}_risk"
    for c in ("Low", "Medium", "High", "Critical")) + " FROM watch")
oracle("dash_crosstab", "watch tw leg", f"""SELECT {_code('operators', 'operator')} AS op,
  {_code('networks', 'network_type')} AS nt, {_code('states', 'state')} AS st, n, repeat, low, med, high, crit,
  p_low, p_med, p_high, p_crit, prob_sum FROM (
  SELECT operator, network_type, state, COUNT(*) AS n, SUM(repeat_outage_indicator)::BIGINT AS repeat, """ + ", ".join(
    [f"COUNT(*) FILTER (risk_category_final = '{c} Risk') AS {s}" for s, c in
     (("low", "Low"), ("med", "Medium"), ("high", "High"), ("crit", "Critical"))]
    + [f"COUNT(*) FILTER (predicted_risk_category = '{c}') AS p_{s}" for s, c in
       (("low", "Low"), ("med", "Medium"), ("high", "High"), ("crit", "Critical"))]
) + """, round(SUM(predicted_risk_probability), 3) AS prob_sum
  FROM watch JOIN (SELECT tower_id, repeat_outage_indicator FROM tw) USING (tower_id)
  GROUP BY operator, network_type, state)""")

# --- fitted models: what must hold whatever the fit; the results themselves have no SQL
_MODELS = "('Logistic Regression'), ('Random Forest'), ('Gradient Boosting')"
oracle("ml_fit_facts", "split", f"""SELECT m AS model, COUNT(*) AS test_rows,
  COUNT(*) FILTER (next_period_high_risk = 1) AS positives, COUNT(*) AS probabilities, TRUE AS varies,
  TRUE AS gradient_below_tolerance, TRUE AS nodes_agree, TRUE AS accuracy_agrees, COUNT(*) AS in_cells
  FROM split, (VALUES {_MODELS}) t(m) WHERE is_test GROUP BY m""")
oracle("ml_importance_facts", "split", "SELECT feature, TRUE AS not_negative, 1::DOUBLE AS total FROM (" + " UNION ALL ".join(
    [f"SELECT '{c}' AS feature" for c in NUMERIC]
    + [f"SELECT '{c}_onehot_' || {c} FROM {_SEEN[c]}" for c in _LABELS]) + ")")
oracle("ml_persist", "split", f"""SELECT m AS model, row_id, 0::DOUBLE AS difference
  FROM split, (VALUES {_MODELS}) t(m) WHERE is_test""")
oracle("wl_output_facts", "watch", f"""SELECT tower_id, operator, state, city, network_type, latest_uptime,
  historical_total_downtime_minutes, historical_total_outage_count, {_SCORE}, risk_category_final,
  TRUE AS band_agrees, TRUE AS is_place FROM watch""")
oracle("sink_dashboard_json", "tw leg split", f"""SELECT """ + ", ".join(
    f"(SELECT COUNT(*) FROM leg WHERE dimension = '{d}')::INT AS n_{d}"
    for d in ("operators", "networks", "states", "cities", "reasons", "dates")) + f""",
  (SELECT COUNT(*) FROM ({_BOARD}))::INT AS tower_rows, (SELECT least(COUNT(*), 500) FROM tw)::INT AS watch_rows,
  (SELECT COUNT(*) FROM tw) AS towers,
  (SELECT COUNT(*) FROM tw WHERE repeat_outage_indicator = 1) AS repeat_towers,
  (SELECT COUNT(*) FROM tw) AS in_categories, (SELECT COUNT(*) FROM tw) AS in_crosstab,
  'Gradient Boosting,Logistic Regression,Random Forest' AS models,
  (SELECT 3 * COUNT(*) FROM split WHERE is_test)::BIGINT AS in_confusion, 10 AS features""")
oracle("sink_dashboard_legends", "leg", "SELECT dimension, code, value FROM leg")
ORACLES["sink_dashboard_crosstab"] = ORACLES["dash_crosstab"]
