"""SQL for profiling, quality, validation, distributions, features, summaries, roll-ups."""

from __future__ import annotations

from oracles.tables import (
    CATEGORY, LABELS, MEASURES, RAW, TYPED, avg_dec, avg_int, half_up, mean, oracle, pct,
    points, sum_1dp,
)

CLEAN = ", ".join(f"{c}::DOUBLE AS {c}" if c in MEASURES[:2] else c for c in ("row_id", *RAW))
EXPORT = (
    "row_id, tower_id, obs_date, operator, city, state, uptime_percentage::DOUBLE AS uptime_percentage, "
    "downtime_minutes::DOUBLE AS downtime_minutes, outage_count, outage_reason, network_type, "
    "avg_users_affected, outage_severity, reliability_status, high_risk_flag, downtime_hours, "
    "observation_month, day_of_week"
)

# --- sources and sinks
oracle("src_raw_csv", "raw", f"SELECT {', '.join(RAW)} FROM raw")
oracle("src_row_id", "raw", """SELECT row_number() OVER (ORDER BY row_id) AS row_id,
  row_id AS source_row, tower_id, obs_date FROM raw""")
oracle("src_feature_csv", "feat", f"SELECT {EXPORT} FROM feat")
oracle("src_count", "raw", "SELECT COUNT(*) AS raw_row_count FROM raw")
oracle("stg_clean", "clean", f"SELECT {CLEAN} FROM clean")
_FAILED = {
    c: f"({c} IS NOT NULL AND ({TYPED[c]}) IS NULL)" for c in ("obs_date", *MEASURES)
}
oracle("stg_clean_strict", "raw clean", f"""SELECT {CLEAN} FROM clean WHERE row_id NOT IN
  (SELECT row_id FROM raw WHERE {' OR '.join(_FAILED.values())})""")
oracle("stg_reject", "raw", f"""SELECT row_id, {', '.join(f'{e} AS bad_{c}' for c, e in _FAILED.items())}
  FROM raw WHERE {' OR '.join(_FAILED.values())}""")
oracle("sink_clean_csv", "clean", f"SELECT {CLEAN} FROM clean")
oracle("sink_features_csv", "feat", f"SELECT {EXPORT} FROM feat")
oracle("sink_summary_csv", "risk", "SELECT * FROM risk")

# --- profiling
oracle("prof_rowcount", "raw", "SELECT COUNT(*) AS total_rows FROM raw")
oracle("prof_schema", "raw", " UNION ALL ".join(
    f"SELECT {i}::INT AS ordinal_position, '{c}' AS column_name, "
    f"'{'bigint' if c == 'row_id' else 'string'}' AS data_type, COUNT({c}) AS known_values FROM raw"
    for i, c in enumerate(("row_id", *RAW), start=1)))
oracle("prof_sample", "raw", "FROM raw ORDER BY row_id LIMIT 5")
for _q, _c, _n in (("entities", "tower_id", "unique_towers"), ("states", "state", "unique_states"),
                   ("cities", "city", "unique_cities")):
    oracle(f"prof_distinct_{_q}", "raw", f"SELECT COUNT(DISTINCT {_c}) AS {_n} FROM raw")
for _q, _c in (("operator", "operator"), ("network", "network_type"), ("reason", "outage_reason"),
               ("city_list", "city"), ("state_list", "state")):
    oracle(f"prof_distinct_{_q}", "raw", f"SELECT {_c} FROM raw GROUP BY ALL ORDER BY ALL NULLS LAST")
oracle("prof_reason_freq", "raw", "SELECT outage_reason, COUNT(*) AS n FROM raw GROUP BY ALL")
oracle("prof_date_range", "clean", "SELECT MIN(obs_date) AS min_date, MAX(obs_date) AS max_date FROM clean")
oracle("prof_grain", "raw", """SELECT rows_per_key, COUNT(*) AS num_towers_dates FROM
  (SELECT COUNT(*) AS rows_per_key FROM raw GROUP BY tower_id, obs_date) GROUP BY ALL""")
oracle("prof_rows_per_entity", "raw", """SELECT rows_per_tower, COUNT(*) AS num_towers FROM
  (SELECT COUNT(*) AS rows_per_tower FROM raw GROUP BY tower_id) GROUP BY ALL""")

# --- quality
_SHORT = dict(zip(
    ("tower_id", "obs_date", "operator", "city", "state", "uptime", "downtime", "outage_count",
     "outage_reason", "network_type", "avg_users_affected"), RAW))


def _flags(prefix, short, condition):
    return "SELECT " + ", ".join(
        f"COUNT(*) FILTER ({condition.format(_SHORT[s])}) AS {prefix}_{s}" for s in short
    ) + " FROM raw"


_TEXT = ("tower_id", "operator", "city", "state", "network_type")
oracle("dq_nulls", "raw", _flags("null", _SHORT, "{0} IS NULL"))
oracle("dq_blanks", "raw", _flags("blank", _TEXT, "trim({0}) = ''"))
oracle("dq_whitespace", "raw", _flags("ws", (*_TEXT, "outage_reason"), "{0} <> trim({0})"))
oracle("dq_casefold", "raw", " UNION ALL ".join(
    f"SELECT '{c}' AS col, COUNT(DISTINCT {c}) AS raw_distinct, "
    f"COUNT(DISTINCT lower(trim({c}))) AS lower_distinct FROM raw"
    for c in ("operator", "city", "state", "network_type", "outage_reason")))
oracle("dq_dup_rows", "raw", f"""SELECT COUNT(*) AS duplicate_full_rows FROM
  (SELECT {', '.join(RAW)} FROM raw GROUP BY ALL HAVING COUNT(*) > 1)""")
oracle("dq_dup_keys", "raw", """SELECT tower_id, obs_date, COUNT(*) AS n,
  COUNT(DISTINCT uptime_percentage) AS distinct_uptime_values,
  COUNT(DISTINCT downtime_minutes) AS distinct_downtime_values,
  COUNT(DISTINCT outage_count) AS distinct_outage_count_values
  FROM raw GROUP BY ALL HAVING n > 1
  ORDER BY n DESC, tower_id NULLS LAST, obs_date NULLS LAST LIMIT 20""")
oracle("dq_key_format", "raw", """SELECT COUNT(*) AS invalid_tower_id_format FROM raw
  WHERE NOT regexp_full_match(tower_id, '[A-Za-z]{3}-[0-9]+')""")
oracle("dq_date_format", "raw", f"""SELECT
  COUNT(*) - COUNT(*) FILTER (regexp_full_match(obs_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS unparseable_dates,
  COUNT(*) FILTER (({TYPED['obs_date']}) IS NULL) AS impossible_dates FROM raw""")
oracle("dq_numeric_format", "raw", "SELECT " + ", ".join(
    f"COUNT(*) FILTER (NOT regexp_full_match({c}, '{p}')) AS {n}" for c, p, n in (
        ("uptime_percentage", "-?[0-9]+([.][0-9]+)?", "bad_uptime_format"),
        ("downtime_minutes", "-?[0-9]+([.][0-9]+)?", "bad_downtime_format"),
        ("outage_count", "-?[0-9]+", "bad_outage_count_format"),
        ("avg_users_affected", "-?[0-9]+", "bad_avg_users_format"))) + " FROM raw")
oracle("dq_functional_dep", "raw",
       "SELECT city, COUNT(DISTINCT state) AS distinct_states_for_city FROM raw GROUP BY city")
oracle("dq_entity_instability", "tw", " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, COUNT(*) AS entities, COUNT(*) FILTER (distinct_{c}_count > 1) AS unstable, "
    f"{pct(f'COUNT(*) FILTER (distinct_{c}_count > 1)', 'COUNT(*)', 1)} AS pct FROM tw" for c in LABELS))
oracle("dq_prefix_dep", "obs", """SELECT COUNT(*) AS determinants, COUNT(*) FILTER (n > 1) AS mismatches
  FROM (SELECT left(tower_id, 3) AS prefix, COUNT(DISTINCT city) AS n FROM obs GROUP BY ALL)""")

# --- validation (u, d, o, a = uptime, downtime, outages, users as numbers)
for _name, _out, _cond in (
    ("uptime_range", "uptime_out_of_range", "u NOT BETWEEN 0 AND 100"),
    ("downtime_neg", "downtime_negative", "d < 0"),
    ("outages_neg", "outage_count_negative", "o < 0"),
    ("users_neg", "users_affected_negative", "a < 0"),
    ("zero_outage_downtime", "zero_outages_but_downtime", "o = 0 AND d > 0"),
    ("outage_zero_downtime", "outages_but_zero_downtime", "o > 0 AND d = 0"),
    ("zero_outage_users", "zero_outages_but_users_affected", "o = 0 AND a > 0"),
    ("outage_zero_users", "outages_but_zero_users_affected", "o > 0 AND a = 0"),
    ("reason_zero_outage", "reason_present_but_zero_outage_count", "outage_reason IS NOT NULL AND o = 0"),
    ("null_reason_outage", "null_reason_but_outage_occurred", "outage_reason IS NULL AND o > 0"),
):
    oracle(f"val_{_name}", "num", f"SELECT COUNT(*) AS {_out} FROM num WHERE {_cond}")
for _name, _v, _out in (("uptime", "u", "uptime"), ("downtime", "d", "downtime"),
                        ("outages", "o", "outage_count"), ("users", "a", "users")):
    oracle(f"val_{_name}_minmax", "num",
           f"SELECT MIN({_v}) AS min_{_out}, MAX({_v}) AS max_{_out} FROM num")
oracle("val_corr_pairs", "num", """SELECT round(corr(u, d), 6) AS corr_uptime_downtime,
  round(corr(d, o), 6) AS corr_downtime_outagecount, round(corr(o, a), 6) AS corr_outagecount_users FROM num""")
oracle("val_percentiles", "num", "SELECT " + ", ".join(
    f"round(quantile_cont({v}, {p}), 6) AS {n}" for v, p, n in (
        ("u", 0.01, "p01_uptime"), ("u", 0.99, "p99_uptime"), ("d", 0.01, "p01_downtime"),
        ("d", 0.99, "p99_downtime"), ("a", 0.99, "p99_users"))) + " FROM num")
oracle("val_clean_ranges", "clean", "SELECT " + ", ".join(
    f"MIN({c}){t} AS min_{n}, MAX({c}){t} AS max_{n}" for c, n, t in (
        ("uptime_percentage", "uptime", "::DOUBLE"), ("downtime_minutes", "downtime", "::DOUBLE"),
        ("outage_count", "outage_count", ""), ("avg_users_affected", "users", ""),
        ("obs_date", "date", ""))) + " FROM clean")

# --- distributions
_IQR = (("u", "uptime"), ("d", "downtime"), ("o", "outage"), ("a", "users"))
_QUART = "SELECT " + ", ".join(
    f"quantile_cont({v}, 0.25) AS q1_{n}, quantile_cont({v}, 0.75) AS q3_{n}" for v, n in _IQR
) + " FROM num"
oracle("out_iqr_bounds", "num", "SELECT " + ", ".join(
    f"round(q1_{n}, 6) AS q1_{n}, round(q3_{n}, 6) AS q3_{n}, round(q3_{n} - q1_{n}, 6) AS iqr_{n}, "
    f"round(q1_{n} - 1.5::DOUBLE * (q3_{n} - q1_{n}), 6) AS lower_fence_{n}, "
    f"round(q3_{n} + 1.5::DOUBLE * (q3_{n} - q1_{n}), 6) AS upper_fence_{n}"
    for _, n in _IQR) + f" FROM ({_QUART})")
oracle("out_iqr_counts", "num", "SELECT " + ", ".join(
    f"COUNT(*) FILTER ({v} NOT BETWEEN q1_{n} - 1.5::DOUBLE * (q3_{n} - q1_{n}) AND "
    f"q3_{n} + 1.5::DOUBLE * (q3_{n} - q1_{n})) AS outliers_{n}" for v, n in _IQR
) + f" FROM num, ({_QUART})")
oracle("out_tail_values", "obs", """SELECT downtime_minutes::DOUBLE AS downtime_minutes, COUNT(*) AS n
  FROM obs WHERE downtime_minutes > 200 GROUP BY ALL ORDER BY 1 DESC LIMIT 15""")


def _buckets(column, low, high, n):
    x = f"{column}::DOUBLE"
    return f"""SELECT CAST(CASE WHEN {x} < {low} THEN 0 WHEN {x} >= {high} THEN {n + 1}
      ELSE floor(({x} - {low}) * {n} / {high - low}) + 1 END AS BIGINT) AS bucket,
      MIN({x}) AS bucket_min, MAX({x}) AS bucket_max, COUNT(*) AS n FROM obs GROUP BY bucket"""


oracle("out_bucket_downtime", "obs", _buckets("downtime_minutes", 0, 220, 22))
oracle("out_bucket_uptime", "obs", _buckets("uptime_percentage", 85, 100, 15))
oracle("out_cap_check", "obs", """SELECT COUNT(*) FILTER (avg_users_affected = 0) AS exactly_zero,
  COUNT(*) FILTER (avg_users_affected = 500) AS exactly_500_cap, MAX(avg_users_affected) AS max_val FROM obs""")
oracle("out_value_freq", "obs", "SELECT outage_count, COUNT(*) AS n FROM obs GROUP BY ALL")
oracle("out_describe", "obs", " UNION ALL ".join(
    f"""SELECT '{c}' AS measure, COUNT({c}) AS count, round({mean(c)}, 6) AS mean,
    round(stddev_samp({c}::DOUBLE), 6) AS std, MIN({c})::DOUBLE AS min,
    round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50,
    round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, MAX({c})::DOUBLE AS max FROM obs""" for c in MEASURES))
oracle("out_value_counts", "feat", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, COUNT(*) AS n FROM feat GROUP BY {c}"
    for c in ("operator", "network_type", "outage_reason", "outage_severity", "reliability_status",
              "high_risk_flag", "observation_month", "day_of_week")))
# Every bin with the rows in it: equal widths, or one bin for each whole number.
_WIDE = """SELECT '{c}' AS measure, k::INT AS bin, (SELECT COUNT(*) FROM obs
    WHERE least(floor(({c}::DOUBLE - lo) / ((hi - lo) / 30)), 29) = k) AS n
  FROM (SELECT MIN({c}::DOUBLE) AS lo, MAX({c}::DOUBLE) AS hi FROM obs), range(0, 30) t(k)"""
_WHOLE = """SELECT '{c}' AS measure, (v - (SELECT MIN({c}) FROM obs))::INT AS bin,
    (SELECT COUNT(*) FROM obs WHERE {c} = v) AS n
  FROM (SELECT unnest(range((SELECT MIN({c}) FROM obs), (SELECT MAX({c}) FROM obs) + 1)) AS v)"""
oracle("prof_distinct_sketch", "obs",
       "SELECT COUNT(DISTINCT tower_id) AS unique_towers, TRUE AS within_bound FROM obs")
oracle("out_histograms", "obs", " UNION ALL ".join(
    (_WHOLE if c == "outage_count" else _WIDE).format(c=c) for c in MEASURES))
oracle("out_boxplot", "obs", " UNION ALL ".join(
    f"""SELECT '{c}' AS measure, round(MIN(x) FILTER (ok), 6) AS whisker_low, round(any_value(q[1]), 6) AS q1,
    round(any_value(q[2]), 6) AS median, round(any_value(q[3]), 6) AS q3,
    round(MAX(x) FILTER (ok), 6) AS whisker_high, COUNT(*) FILTER (NOT ok) AS outliers
    FROM (SELECT {c}::DOUBLE AS x, q,
          x BETWEEN q[1] - 1.5::DOUBLE * (q[3] - q[1]) AND q[3] + 1.5::DOUBLE * (q[3] - q[1]) AS ok
          FROM obs, (SELECT quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM obs))"""
    for c in MEASURES))
oracle("out_corr_matrix", "obs", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS r FROM obs"
    for a in MEASURES for b in MEASURES))
oracle("out_mixture_corr", "obs", """SELECT
  round(corr(downtime_minutes::DOUBLE, avg_users_affected::DOUBLE), 6) AS r_overall,
  round(corr(downtime_minutes::DOUBLE, avg_users_affected::DOUBLE) FILTER (avg_users_affected > 0), 6)
    AS r_impactful_only FROM obs""")

oracle("out_scatter_sample", "obs", """SELECT row_id, downtime_minutes::DOUBLE AS downtime_minutes,
  avg_users_affected, avg_users_affected > 0 AS has_impact FROM obs
  ORDER BY md5(row_id::VARCHAR || ':42'), row_id LIMIT 8000""")

# --- row features
oracle("feat_calendar", "feat", """SELECT row_id, obs_date, obs_year, obs_quarter, obs_month_number,
  obs_month_name, obs_week_number, obs_day_of_week_name, obs_day_of_week_number, is_weekend FROM feat""")
oracle("feat_month_check", "feat", """SELECT obs_year, obs_quarter, obs_month_number, obs_month_name,
  COUNT(*) AS n FROM feat GROUP BY ALL""")
oracle("feat_dow_check", "feat", """SELECT obs_day_of_week_name, obs_day_of_week_number, is_weekend,
  COUNT(*) AS n FROM feat GROUP BY ALL""")
for _name, _c in (
    ("reliability", "reliability_status"), ("high_risk", "high_risk_flag"),
    ("downtime_hours", "downtime_hours"), ("obs_month", "observation_month"),
    ("dow", "day_of_week"), ("severity", "outage_severity"),
):
    oracle(f"feat_{_name}", "feat", f"SELECT row_id, {_c} FROM feat")
for _name, _c in (("status", "reliability_status"), ("severity", "outage_severity"),
                  ("flag", "high_risk_flag")):
    oracle(f"feat_{_name}_dist", "feat", f"SELECT {_c}, COUNT(*) AS n FROM feat GROUP BY ALL")

# --- entity summary and preliminary risk
for _name, _c in (("operator", "operator"), ("network", "network_type"), ("state", "state")):
    oracle(f"ent_mode_{_name}", "obs", f"""SELECT tower_id, {_c} AS mode_{_c} FROM
      (SELECT tower_id, {_c}, COUNT(*) AS n FROM obs GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY tower_id ORDER BY n DESC, {_c}) = 1""")
oracle("ent_agg", "tw", """SELECT tower_id, city, total_observations, avg_uptime_percentage,
  total_downtime_minutes, total_outage_count, total_users_affected, impactful_outage_observations,
  distinct_operator_count, distinct_state_count, distinct_network_type_count FROM tw""")
oracle("ent_summary", "tw", "FROM tw")
oracle("ent_repeat_dist", "tw", "SELECT repeat_outage_indicator, COUNT(*) AS n FROM tw GROUP BY ALL")
oracle("ent_quartiles", "lim", "FROM lim")
oracle("risk_points", "risk", "SELECT tower_id, risk_points FROM risk")
oracle("risk_points_published", "tw", f"""SELECT tower_id, risk_points,
  {CATEGORY.format("risk_points")} AS site_risk_category_preliminary
  FROM (SELECT *, {points("89.44::DOUBLE", "202.32::DOUBLE", "410")} AS risk_points FROM tw)""")
oracle("risk_category_prelim", "risk", "SELECT tower_id, site_risk_category_preliminary FROM risk")


def _shares(table, column, name, digits, out="pct", where=""):
    total = "SUM(COUNT(*)) OVER ()"
    return (f"SELECT {column}, COUNT(*) AS {name}, {pct('COUNT(*)', total, digits)} AS {out} "
            f"FROM {table} {where} GROUP BY {column}")


oracle("risk_prelim_dist", "risk", _shares("risk", "site_risk_category_preliminary", "n", 1))
oracle("risk_by_multiplicity", "risk", """SELECT
  CASE WHEN distinct_operator_count > 1 THEN 'Multi-operator tower' ELSE 'Single-operator tower' END AS tower_type,
  site_risk_category_preliminary, COUNT(*) AS n FROM risk GROUP BY ALL""")
oracle("risk_backjoin", "obs risk", """SELECT row_id, tower_id, repeat_outage_indicator,
  site_risk_category_preliminary FROM obs LEFT JOIN risk USING (tower_id)""")
oracle("risk_backjoin_nulls", "obs risk", """SELECT
  COUNT(*) FILTER (repeat_outage_indicator IS NULL) AS null_repeat_flag,
  COUNT(*) FILTER (site_risk_category_preliminary IS NULL) AS null_risk_cat
  FROM obs LEFT JOIN risk USING (tower_id)""")
oracle("recon_layers", "raw clean", """SELECT (SELECT COUNT(*) FROM raw) AS raw_rows,
  (SELECT COUNT(*) FROM clean) AS clean_rows, (SELECT COUNT(*) FROM clean) AS feature_rows,
  (SELECT COUNT(DISTINCT tower_id) FROM clean) AS tower_summary_rows,
  (SELECT COUNT(DISTINCT tower_id) FROM clean) AS distinct_towers""")

# --- roll-ups
_IMPACT = "COUNT(*) FILTER (avg_users_affected > 0)"
_METRIC = {
    "n": "COUNT(*)",
    "observations": "COUNT(*)",
    "avg_uptime_pct": avg_dec("uptime_percentage", 2),
    "avg_downtime_minutes": avg_dec("downtime_minutes", 2),
    "avg_outage_count": avg_int("outage_count", 2),
    "avg_users_affected": avg_int("avg_users_affected", 1),
    "total_downtime_minutes": sum_1dp("downtime_minutes"),
    "total_outages": "SUM(outage_count)::BIGINT",
    "total_users_affected": "SUM(avg_users_affected)::BIGINT",
    "avg_uptime": mean("uptime_percentage"),
    "avg_downtime": mean("downtime_minutes"),
    "total_downtime": "SUM(downtime_minutes)::DOUBLE",
}


def _group(by, *metrics, where="", tail=""):
    columns = ", ".join([*by, *[m if " AS " in m else f"{_METRIC[m]} AS {m}" for m in metrics]])
    where = f"WHERE {where}" if where else ""
    return f"SELECT {columns} FROM feat {where} GROUP BY {', '.join(by)} {tail}"


_CAUSED = "outage_reason IS NOT NULL"
_N_CAUSED = "COUNT(outage_reason)"
oracle("biz_overview", "feat", f"""SELECT COUNT(DISTINCT tower_id) AS unique_towers, COUNT(*) AS total_observations,
  SUM(outage_count)::BIGINT AS total_outages, {_METRIC['total_downtime_minutes']} AS total_downtime_minutes,
  {_METRIC['avg_uptime_pct']} AS avg_uptime_pct, {_METRIC['avg_downtime_minutes']} AS avg_downtime_minutes,
  {_METRIC['avg_outage_count']} AS avg_outage_count, SUM(avg_users_affected)::BIGINT AS total_users_affected,
  {_METRIC['avg_users_affected']} AS avg_users_affected_per_obs, {_IMPACT} AS outage_affected_observations,
  {pct(_IMPACT, 'COUNT(*)', 2)} AS pct_obs_with_impact FROM feat""")
_REPEAT = "SUM(repeat_outage_indicator)::BIGINT"
oracle("biz_entity_overview", "tw", f"""SELECT COUNT(*) AS towers,
  {half_up("SUM(CAST(round(avg_uptime_percentage * 100) AS HUGEINT))", "COUNT(*)", 2, 2)} AS avg_tower_uptime_pct,
  round(AVG(total_downtime_minutes / total_observations), 2) AS avg_downtime_per_observation,
  round(AVG(total_outage_count / total_observations), 2) AS avg_outage_count_per_observation,
  {_REPEAT} AS repeat_outage_towers, {pct(_REPEAT, 'COUNT(*)', 2)} AS pct_repeat_outage_towers FROM tw""")
oracle("biz_risk_mix", "risk", _shares("risk", "site_risk_category_preliminary", "towers", 1))
oracle("biz_operator", "feat", _group(
    ["operator"], "observations", "COUNT(DISTINCT tower_id) AS distinct_towers_seen", "avg_uptime_pct",
    "avg_downtime_minutes", "total_downtime_minutes", "avg_outage_count", "total_outages",
    "avg_users_affected", "total_users_affected", f"{_IMPACT} AS impactful_observations",
    f"{pct(_IMPACT, 'COUNT(*)', 2)} AS pct_impactful"))
oracle("biz_operator_reason", "feat", _group(["operator", "outage_reason"], "n", where=_CAUSED))
oracle("biz_operator_severity", "feat", _group(["operator", "outage_severity"], "n"))


def _spread(by, column, names, digits, where="TRUE"):
    n, s, ss = "SUM(n)", "SUM(s)", "SUM(ss)"
    return f"""SELECT round(MAX(s::DOUBLE / 100 / n) - MIN(s::DOUBLE / 100 / n), {digits}) AS {names[0]},
      round(sqrt(({n} * {ss} - {s} * {s})::DOUBLE / 10000 / ({n}::DOUBLE * ({n}::DOUBLE - 1))), {digits}) AS {names[1]}
      FROM (SELECT COUNT(*)::HUGEINT AS n, SUM(c)::HUGEINT AS s, SUM(c * c)::HUGEINT AS ss
            FROM (SELECT {by}, CAST({column} * 100 AS BIGINT) AS c FROM feat WHERE {where}) GROUP BY {by})"""


for _q, _by, _label in (("operator", "operator", "operator"), ("state", "state", "state"),
                        ("city", "city", "city"), ("network", "network_type", "network")):
    oracle(f"biz_{_q}_spread", "feat", _spread(
        _by, "uptime_percentage", (f"range_of_{_label}_avg_uptime", "overall_uptime_stddev"), 3))
oracle("biz_cause_spread", "feat", _spread(
    "outage_reason", "downtime_minutes", ("range_of_cause_avg_downtime", "overall_downtime_stddev"), 2,
    _CAUSED))
oracle("biz_state_outages", "feat", _group(
    ["state"], "observations", "total_outages", "avg_outage_count", "total_downtime_minutes",
    "avg_uptime_pct", tail="ORDER BY total_outages DESC, state LIMIT 10"))
oracle("biz_state_downtime", "feat", _group(
    ["state"], "total_downtime_minutes", tail="ORDER BY total_downtime_minutes DESC, state LIMIT 10"))
oracle("biz_city_worst", "feat", _group(
    ["city"], "observations", "avg_uptime_pct", "total_downtime_minutes", "total_outages",
    "total_users_affected", tail="ORDER BY avg_uptime_pct, city LIMIT 15"))
oracle("biz_repeat_entities", "tw", """SELECT tower_id, city, mode_operator, total_observations,
  impactful_outage_observations, repeat_outage_indicator, avg_uptime_percentage, total_downtime_minutes,
  total_users_affected FROM tw WHERE repeat_outage_indicator = 1
  ORDER BY impactful_outage_observations DESC, total_downtime_minutes DESC, tower_id LIMIT 15""")
oracle("biz_lowest_uptime", "tw", """SELECT tower_id, city, mode_operator, total_observations,
  avg_uptime_percentage, total_downtime_minutes, total_users_affected FROM tw
  ORDER BY avg_uptime_percentage, tower_id LIMIT 15""")
oracle("biz_city_impact", "tw", f"""SELECT city, SUM(total_users_affected)::BIGINT AS total_users_affected,
  COUNT(*) AS towers, {avg_int("tw.total_users_affected", 1)} AS avg_users_affected_per_tower
  FROM tw GROUP BY city ORDER BY SUM(tw.total_users_affected) DESC, city LIMIT 10""")
oracle("biz_cause_freq", "feat", _shares(
    "feat", "outage_reason", "n", 2, "pct_of_impactful_obs", f"WHERE {_CAUSED}"))
for _q, _m in (("downtime", ("total_downtime_minutes", "avg_downtime_minutes")),
               ("users", ("total_users_affected", "avg_users_affected")),
               ("uptime", ("avg_uptime_pct", "n"))):
    # Qualified inputs, as some outputs share the name of a column.
    oracle(f"biz_cause_{_q}", "feat", _group(["outage_reason"], *_m, where=_CAUSED))
oracle("biz_cause_recurring", "feat", f"""SELECT outage_reason, COUNT(*) AS tower_occurrences FROM
  (SELECT tower_id, outage_reason FROM feat WHERE {_CAUSED} GROUP BY ALL HAVING COUNT(*) > 1)
  GROUP BY outage_reason""")
oracle("biz_cause_severity", "feat", _group(["outage_reason", "outage_severity"], "n", where=_CAUSED))
oracle("biz_network", "feat", _group(
    ["network_type"], "observations", "avg_uptime_pct", "avg_downtime_minutes", "avg_outage_count",
    "avg_users_affected", f"{_N_CAUSED} AS impactful_observations",
    f"{pct(_N_CAUSED, 'COUNT(*)', 2)} AS pct_impactful"))
oracle("biz_network_reason", "feat", _group(["network_type", "outage_reason"], "n", where=_CAUSED))
_TREND = ("observations", "total_outages", "total_downtime_minutes", "avg_uptime_pct")
_AVERAGES = ("observations", "avg_uptime_pct", "avg_downtime_minutes", "avg_outage_count")
oracle("biz_daily", "feat", _group(["obs_date"], *_TREND))
oracle("st_daily", "feat", _group(["obs_date"], *_TREND))
oracle("biz_daily_spread", "feat", f"""SELECT round(MAX(m) - MIN(m), 6) AS range_of_daily_avg_uptime,
  round(stddev_samp(m), 6) AS stddev_of_daily_avgs
  FROM (SELECT {mean("uptime_percentage")} AS m FROM feat GROUP BY obs_date)""")
oracle("biz_dow", "feat", _group(
    ["obs_day_of_week_name", "obs_day_of_week_number", "is_weekend"], *_AVERAGES))
oracle("biz_weekend", "feat", _group(["is_weekend"], *_AVERAGES))
_WEEK = ("MIN(obs_date) AS week_start", "MAX(obs_date) AS week_end")
oracle("biz_weekly", "feat", _group(["obs_week_number"], *_WEEK, *_TREND))
oracle("biz_weekly_with_year", "feat", _group(["obs_year", "obs_week_number"], *_WEEK, *_TREND))
oracle("biz_monthly", "feat", _group(["obs_year", "obs_month_name", "obs_month_number"], *_TREND))

oracle("pd_operator", "feat", _group(["operator"], "avg_uptime", "avg_downtime", "total_outages"))
oracle("pd_network", "feat", _group(["network_type"], "avg_uptime", "total_outages"))
oracle("pd_cause_ordered", "feat", """SELECT c.position::INT AS position, c.cause AS outage_reason, n,
  total_downtime, total_users FROM (VALUES (0, 'power_failure'), (1, 'equipment_fault'), (2, 'maintenance'),
    (3, 'fiber_cut'), (4, 'weather')) c(position, cause)
  LEFT JOIN (SELECT outage_reason, COUNT(*) AS n, SUM(downtime_minutes)::DOUBLE AS total_downtime,
    SUM(avg_users_affected)::BIGINT AS total_users FROM feat GROUP BY outage_reason) f ON f.outage_reason = c.cause""")
oracle("pd_state_top_outages", "feat", _group(
    ["state"], "total_outages", tail="ORDER BY total_outages DESC, state LIMIT 10"))
oracle("pd_state_top_downtime", "feat", _group(
    ["state"], "total_downtime", tail="ORDER BY total_downtime DESC, state LIMIT 10"))
oracle("pd_state_top", "feat", " UNION ALL ".join(
    f"(SELECT '{n}' AS ranking, state, {e}::DOUBLE AS total FROM feat GROUP BY state "
    f"ORDER BY {e} DESC, state LIMIT 10)"
    for n, e in (("total_outages", "SUM(outage_count)"), ("total_downtime", "SUM(downtime_minutes)"))))
oracle("pd_city_rank", "feat", _group(["city"], "avg_uptime", "total_outages"))
oracle("pd_worst15", "tw", """SELECT tower_id, city, avg_uptime_percentage, total_downtime_minutes FROM tw
  ORDER BY avg_uptime_percentage, tower_id LIMIT 15""")
oracle("pd_daily", "feat", _group(["obs_date"], "total_outages", "total_downtime", "avg_uptime"))
oracle("pd_monthly", "feat", f"""SELECT strftime(obs_date, '%Y-%m') AS obs_month, COUNT(*) AS observations,
  SUM(outage_count)::BIGINT AS total_outages, {mean("uptime_percentage")} AS avg_uptime FROM feat GROUP BY ALL""")
oracle("pd_crosscheck", "feat", f"""SELECT {_METRIC['avg_uptime_pct']} AS avg_uptime_pct,
  {_METRIC['total_downtime_minutes']} AS total_downtime, SUM(outage_count)::BIGINT AS total_outages,
  SUM(avg_users_affected)::BIGINT AS total_users_affected, TRUE AS avg_uptime_pct_ok,
  TRUE AS total_downtime_ok, TRUE AS total_outages_ok, TRUE AS total_users_affected_ok FROM feat""")
oracle("pd_validate", "obs", """SELECT COUNT(DISTINCT tower_id) AS summary_rows, COUNT(*) AS feature_rows,
  COUNT(DISTINCT tower_id) AS towers, TRUE AS one_row_per_tower FROM obs""")
