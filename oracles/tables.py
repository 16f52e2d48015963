"""Common tables of the oracle queries and helpers for exact rounding."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

LABELS = ("operator", "state", "network_type")
MEASURES = ("uptime_percentage", "downtime_minutes", "outage_count", "avg_users_affected")
RAW = (
    "tower_id", "obs_date", "operator", "city", "state", "uptime_percentage",
    "downtime_minutes", "outage_count", "outage_reason", "network_type", "avg_users_affected",
)

TABLES: dict[str, str] = {}

TABLES["obs"] = """
  SELECT event_id AS row_id,
    CONCAT('CT', chr(CAST(65 + user_id % 15 AS INT)), '-', CAST(user_id * 100 + k AS STRING)) AS tower_id,
    day AS obs_date,
    CONCAT('op_', CAST(event_id % 5 AS STRING)) AS operator,
    CONCAT('city_', CAST(user_id % 15 AS STRING)) AS city,
    CONCAT('state_', CAST(event_id % 37 AS STRING)) AS state,
    CAST((10000 - CAST(FLOOR((c * 10 + 72) / CAST(144 AS DOUBLE)) AS BIGINT)) / CAST(100 AS DOUBLE) AS DECIMAL(6,2)) AS uptime_percentage,
    CAST(c / CAST(100 AS DOUBLE) AS DECIMAL(8,2)) AS downtime_minutes,
    k % 6 AS outage_count,
    CASE event_type WHEN 'click' THEN 'power_failure' WHEN 'error' THEN 'equipment_fault'
         WHEN 'purchase' THEN 'maintenance'
         WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'fiber_cut' ELSE 'weather' END END AS outage_reason,
    CONCAT(CAST(2 + (event_id + k) % 4 AS STRING), 'G') AS network_type,
    CAST(CASE WHEN event_type = 'view' THEN 0 ELSE 1 + (event_id * 7) % 500 END AS INT) AS avg_users_affected
  FROM (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
               LEAST(CAST(ROUND(value * 100) AS BIGINT), 21600) AS c
        FROM events) e
"""

TABLES["raw"] = """
  SELECT row_id,
    CASE WHEN row_id % 211 = 0 THEN CONCAT('T', tower_id) WHEN row_id % 193 = 0 THEN CONCAT(' ', tower_id)
         WHEN row_id % 401 = 0 THEN NULL ELSE tower_id END AS tower_id,
    CASE WHEN row_id % 499 = 0 THEN '2024-13-45' WHEN row_id % 307 = 0 THEN '01/02/2024'
         ELSE CAST(obs_date AS STRING) END AS obs_date,
    CASE WHEN row_id % 97 = 0 THEN UPPER(operator) WHEN row_id % 101 = 0 THEN CONCAT(operator, ' ')
         WHEN row_id % 103 = 0 THEN '  ' ELSE operator END AS operator,
    CASE WHEN row_id % 89 = 0 THEN UPPER(city) ELSE city END AS city,
    state,
    CASE WHEN row_id % 251 = 0 THEN 'n/a' WHEN row_id % 257 = 0 THEN '-1.5'
         WHEN row_id % 263 = 0 THEN '100.01' ELSE CAST(uptime_percentage AS STRING) END AS uptime_percentage,
    CASE WHEN row_id % 269 = 0 THEN '-3' ELSE CAST(downtime_minutes AS STRING) END AS downtime_minutes,
    CASE WHEN row_id % 271 = 0 THEN '1.5' ELSE CAST(outage_count AS STRING) END AS outage_count,
    CASE WHEN row_id % 277 = 0 THEN '' ELSE outage_reason END AS outage_reason,
    CASE WHEN row_id % 281 = 0 THEN LOWER(network_type) ELSE network_type END AS network_type,
    CASE WHEN row_id % 283 = 0 THEN NULL ELSE CAST(avg_users_affected AS STRING) END AS avg_users_affected
  FROM obs
  UNION ALL
  SELECT row_id + 100000000, tower_id, CAST(obs_date AS STRING), operator, city, state,
    CAST(uptime_percentage AS STRING), CAST(downtime_minutes AS STRING), CAST(outage_count AS STRING),
    outage_reason, network_type, CAST(avg_users_affected AS STRING)
  FROM obs WHERE row_id % 331 = 0
"""

_NUMERIC = "'^-?[0-9]+([.][0-9]+)?$'"
_WHOLE = "'^-?[0-9]+$'"
_DAY = "'^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"


def guarded(column: str, pattern: str, kind: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({column}), {pattern}) "
        f"THEN TRY_CAST(trim({column}) AS {kind}) END"
    )


# Raw rows with their numbers as doubles.
TABLES["num"] = "SELECT *, " + ", ".join(
    f"{guarded(c, _NUMERIC, 'DOUBLE')} AS {v}" for c, v in zip(MEASURES, ("u", "d", "o", "a"))
) + " FROM raw"

TYPED = {
    "tower_id": "trim(tower_id)",
    "obs_date": f"CASE WHEN regexp_matches(obs_date, {_DAY}) THEN TRY_CAST(obs_date AS DATE) END",
    "operator": "trim(operator)",
    "city": "trim(city)",
    "state": "trim(state)",
    "uptime_percentage": guarded("uptime_percentage", _NUMERIC, "DECIMAL(6,2)"),
    "downtime_minutes": guarded("downtime_minutes", _NUMERIC, "DECIMAL(8,2)"),
    "outage_count": guarded("outage_count", _WHOLE, "INT"),
    "outage_reason": "nullif(trim(outage_reason), '')",
    "network_type": "trim(network_type)",
    "avg_users_affected": guarded("avg_users_affected", _WHOLE, "INT"),
}
TABLES["clean"] = (
    "SELECT row_id, " + ", ".join(f"{e} AS {c}" for c, e in TYPED.items()) + " FROM raw"
)

BANDS = """CASE WHEN uptime_percentage >= 99 THEN 'Excellent' WHEN uptime_percentage >= 95 THEN 'Good'
       WHEN uptime_percentage >= 90 THEN 'Fair' ELSE 'Poor' END"""
SEVERITY = """CASE WHEN downtime_minutes >= 120 OR outage_count >= 4 THEN 'High'
       WHEN downtime_minutes >= 60 OR outage_count >= 2 THEN 'Medium' ELSE 'Low' END"""

TABLES["feat"] = f"""
  SELECT *,
    year(obs_date)::INT AS obs_year, quarter(obs_date)::INT AS obs_quarter,
    month(obs_date)::INT AS obs_month_number, strftime(obs_date, '%B') AS obs_month_name,
    week(obs_date)::INT AS obs_week_number, strftime(obs_date, '%A') AS obs_day_of_week_name,
    isodow(obs_date)::INT AS obs_day_of_week_number, isodow(obs_date) >= 6 AS is_weekend,
    {BANDS} AS reliability_status,
    CASE WHEN uptime_percentage < 95 THEN 1 ELSE 0 END AS high_risk_flag,
    ((CAST(downtime_minutes * 100 AS BIGINT) * 20000 + 6000) // 12000)::DOUBLE / 10000 AS downtime_hours,
    strftime(obs_date, '%Y-%m') AS observation_month, strftime(obs_date, '%A') AS day_of_week,
    {SEVERITY} AS outage_severity
  FROM obs
"""


def cents(column: str) -> str:
    return f"SUM(CAST({column} * 100 AS HUGEINT))"


def half_up(total: str, n: str, scale: int, digits: int) -> str:
    """``total / 10^scale / n`` rounded half up to ``digits``, for totals that are not negative."""
    a, b = 10**digits, 10**scale
    return f"((2 * {total} * {a} + {b} * {n}) // (2 * {b} * {n}))::DOUBLE / {a}"


def avg_dec(column: str, digits: int) -> str:
    return half_up(cents(column), f"COUNT({column})", 2, digits)


def avg_int(column: str, digits: int) -> str:
    return half_up(f"SUM(CAST({column} AS HUGEINT))", f"COUNT({column})", 0, digits)


def pct(part: str, whole: str, digits: int) -> str:
    return half_up(f"CAST({part} AS HUGEINT) * 100", whole, 0, digits)


def sum_1dp(column: str) -> str:
    return f"(({cents(column)} + 5) // 10)::DOUBLE / 10"


def mean(column: str) -> str:
    return f"SUM({column})::DOUBLE / COUNT({column})"


TABLES["tw"] = f"""
  SELECT tower_id, MIN(city) AS city,
    {", ".join(f"mode() WITHIN GROUP (ORDER BY {c}) AS mode_{c}, COUNT(DISTINCT {c}) AS distinct_{c}_count" for c in LABELS)},
    COUNT(*) AS total_observations,
    {avg_dec("uptime_percentage", 2)} AS avg_uptime_percentage,
    SUM(downtime_minutes)::DOUBLE AS total_downtime_minutes,
    SUM(outage_count)::BIGINT AS total_outage_count,
    SUM(avg_users_affected)::BIGINT AS total_users_affected,
    COUNT(*) FILTER (avg_users_affected > 0) AS impactful_outage_observations,
    CASE WHEN COUNT(*) FILTER (avg_users_affected > 0) > 1 THEN 1 ELSE 0 END AS repeat_outage_indicator
  FROM obs GROUP BY tower_id
"""
TABLES["lim"] = """
  SELECT quantile_cont(avg_uptime_percentage, 0.25) AS q1_avg_uptime,
    quantile_cont(total_downtime_minutes, 0.75) AS q3_total_downtime,
    quantile_cont(total_users_affected::DOUBLE, 0.75) AS q3_total_users
  FROM tw
"""


def points(uptime: str, downtime: str, users: str) -> str:
    return (
        f"((avg_uptime_percentage < {uptime})::INT + (total_downtime_minutes > {downtime})::INT"
        f" + (total_users_affected > {users})::INT + repeat_outage_indicator)"
    )


CATEGORY = "(['Low Risk', 'Medium Risk', 'High Risk', 'Critical Risk'])[least({}, 3) + 1]"

TABLES["risk"] = f"""
  SELECT t.*, {CATEGORY.format("risk_points")} AS site_risk_category_preliminary
  FROM (SELECT tw.*, {points("q1_avg_uptime", "q3_total_downtime", "q3_total_users")} AS risk_points
        FROM tw, lim) t
"""

# Every row joined with the earlier rows of its entity.
_PAIRS = """FROM obs a JOIN obs b ON a.tower_id = b.tower_id
    AND (b.obs_date < a.obs_date OR (b.obs_date = a.obs_date AND b.row_id < a.row_id))"""


def history(alias: str) -> str:
    b = alias
    labels = ", ".join(
        f"mode() WITHIN GROUP (ORDER BY {b}.{c}) AS hist_mode_{c}" for c in LABELS
    )
    return f"""COUNT(*) AS hist_num_observations,
    {mean(f"{b}.uptime_percentage")} AS hist_avg_uptime,
    MIN({b}.uptime_percentage)::DOUBLE AS hist_min_uptime,
    {mean(f"{b}.downtime_minutes")} AS hist_avg_downtime,
    MAX({b}.downtime_minutes)::DOUBLE AS hist_max_downtime,
    SUM({b}.downtime_minutes)::DOUBLE AS hist_total_downtime,
    {mean(f"{b}.outage_count")} AS hist_avg_outage_count,
    SUM({b}.outage_count)::BIGINT AS hist_total_outage_count,
    {mean(f"{b}.avg_users_affected")} AS hist_avg_users_affected,
    (COUNT(*) FILTER ({b}.avg_users_affected > 0))::DOUBLE / COUNT(*) AS hist_pct_impactful,
    {labels},
    first({b}.city ORDER BY {b}.obs_date, {b}.row_id) AS hist_city"""


TABLES["hist"] = f"""
  SELECT a.row_id, a.tower_id, a.obs_date AS target_date,
    CASE WHEN a.uptime_percentage < 95 THEN 1 ELSE 0 END AS next_period_high_risk,
    {history("b")}
  {_PAIRS}
  GROUP BY a.row_id, a.tower_id, a.obs_date, a.uptime_percentage
"""
TABLES["cut"] = """
  SELECT target_date AS split_date FROM (
    SELECT target_date, row_number() OVER (ORDER BY target_date) - 1 AS place,
           CAST(floor(COUNT(*) OVER () * 0.8::DOUBLE) AS BIGINT) AS wanted
    FROM hist) WHERE place = wanted
"""
TABLES["split"] = "SELECT hist.*, split_date, target_date >= split_date AS is_test FROM hist, cut"

TABLES["rate"] = f"""
  SELECT tower_id, {mean("uptime_percentage")} AS avg_uptime_percentage,
    {mean("downtime_minutes")} AS avg_downtime_minutes, {mean("outage_count")} AS avg_outage_count,
    {mean("avg_users_affected")} AS avg_users_affected,
    (COUNT(*) FILTER (avg_users_affected > 0))::DOUBLE / COUNT(*) AS pct_impactful,
    COUNT(*) AS total_observations
  FROM obs GROUP BY tower_id
"""


def scaled(column: str) -> str:
    return f"({column} - MIN({column}) OVER ()) / (MAX({column}) OVER () - MIN({column}) OVER ())"


TABLES["comp"] = f"""
  SELECT tower_id, total_observations,
    {scaled("avg_downtime_minutes")} AS norm_downtime_risk,
    1 - {scaled("avg_uptime_percentage")} AS norm_uptime_risk,
    {scaled("avg_users_affected")} AS norm_impact_risk,
    {scaled("pct_impactful")} AS norm_frequency_risk
  FROM rate
"""
TABLES["score"] = """
  SELECT *, (0.25::DOUBLE * norm_downtime_risk + 0.25::DOUBLE * norm_uptime_risk
    + 0.25::DOUBLE * norm_impact_risk + 0.25::DOUBLE * norm_frequency_risk) * 100 AS site_reliability_risk_score
  FROM comp
"""
TABLES["qs"] = """
  SELECT quantile_cont(site_reliability_risk_score, 0.25) AS q1,
    quantile_cont(site_reliability_risk_score, 0.5) AS q2,
    quantile_cont(site_reliability_risk_score, 0.75) AS q3 FROM score
"""
TABLES["final"] = """
  SELECT score.*, CASE WHEN site_reliability_risk_score <= q1 THEN 'Low Risk'
    WHEN site_reliability_risk_score <= q2 THEN 'Medium Risk'
    WHEN site_reliability_risk_score <= q3 THEN 'High Risk' ELSE 'Critical Risk' END AS risk_category_final
  FROM score, qs
"""
TABLES["pred"] = """
  SELECT row_id, CAST((row_id * 37) % 1000 AS DOUBLE) / 1000 AS p,
    CASE WHEN uptime_percentage < 95 THEN 1 ELSE 0 END AS label FROM obs
"""
BAND = """CASE WHEN {0} <= 0.25 THEN 'Low' WHEN {0} <= 0.5 THEN 'Medium'
    WHEN {0} <= 0.75 THEN 'High' ELSE 'Critical' END"""
TABLES["full"] = f"""
  SELECT tower_id, {history("obs")},
    last(uptime_percentage ORDER BY obs_date, row_id)::DOUBLE AS latest_uptime,
    MAX(obs_date) AS latest_date, MAX(row_id) AS last_row
  FROM obs GROUP BY tower_id
"""
TABLES["watch"] = f"""
  SELECT tower_id, hist_mode_operator AS operator, hist_mode_state AS state, hist_city AS city,
    hist_mode_network_type AS network_type, latest_uptime,
    hist_total_downtime AS historical_total_downtime_minutes,
    hist_total_outage_count AS historical_total_outage_count,
    site_reliability_risk_score, risk_category_final, predicted_risk_probability,
    {BAND.format("predicted_risk_probability")} AS predicted_risk_category,
    row_number() OVER (ORDER BY predicted_risk_probability DESC, site_reliability_risk_score DESC, tower_id)
      AS recommended_priority
  FROM (SELECT full_.*, CAST((last_row * 37) % 1000 AS DOUBLE) / 1000 AS predicted_risk_probability
        FROM full_) JOIN final USING (tower_id)
"""
TABLES["full_"] = TABLES.pop("full")
TABLES["leg"] = """
  SELECT dimension, value, CAST(row_number() OVER (PARTITION BY dimension
      ORDER BY CASE WHEN dimension = 'reasons' AND value = 'None' THEN 0 ELSE 1 END, value) - 1 AS INT) AS code
  FROM (SELECT 'operators' AS dimension, operator AS value FROM obs
        UNION SELECT 'networks', network_type FROM obs UNION SELECT 'states', state FROM obs
        UNION SELECT 'cities', city FROM obs
        UNION SELECT 'reasons', coalesce(outage_reason, 'None') FROM obs
        UNION SELECT 'reasons', 'None'
        UNION SELECT 'dates', strftime(obs_date, '%Y-%m-%d') FROM obs)
"""

# What each table is made of, so a query only carries what it reads.
NEEDS = {
    "obs": (), "raw": ("obs",), "num": ("raw",), "clean": ("raw",), "feat": ("obs",),
    "tw": ("obs",), "lim": ("tw",), "risk": ("tw", "lim"), "hist": ("obs",), "cut": ("hist",),
    "split": ("hist", "cut"), "rate": ("obs",), "comp": ("rate",), "score": ("comp",),
    "qs": ("score",), "final": ("score", "qs"), "pred": ("obs",), "full_": ("obs",),
    "watch": ("full_", "final"), "leg": ("obs",),
}


def _collect(names: list[str], done: list[str]) -> list[str]:
    for name in names:
        _collect(list(NEEDS[name]), done)
        if name not in done:
            done.append(name)
    return done


def oracle(name: str, tables: str, sql: str) -> None:
    """Register ``sql`` reading the named common tables."""
    used = _collect(tables.split(), [])
    ctes = ",\n".join(f"{t} AS MATERIALIZED ({TABLES[t]})" for t in used)
    ORACLES[name] = f"WITH {ctes}\n{sql}" if used else sql
