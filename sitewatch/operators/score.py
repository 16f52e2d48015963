"""Rate-based reliability score of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.functions.bands import RISK_LEVELS, at_most
from sitewatch.functions.numeric import mean, share
from sitewatch.operators.quantiles import exact_quantiles
from sitewatch.roles import TOWERS, Roles

# Equal weights of the four components.
EQUAL_WEIGHTS = {
    "norm_downtime_risk": 0.25,
    "norm_uptime_risk": 0.25,
    "norm_impact_risk": 0.25,
    "norm_frequency_risk": 0.25,
}


def entity_rates(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Per-observation averages of every entity; rows without one belong to none."""
    return df.where(F.col(roles.entity).isNotNull()).groupBy(roles.entity).agg(
        mean(roles.uptime).alias("avg_uptime_percentage"),
        mean(roles.downtime).alias("avg_downtime_minutes"),
        mean(roles.outages).alias("avg_outage_count"),
        mean(roles.users).alias("avg_users_affected"),
        share(F.col(roles.users) > 0).alias("pct_impactful"),
        F.count(F.lit(1)).alias("total_observations"),
    )


def rates_of(history: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """The same averages out of ``history.full_history``, which has them under other names."""
    return history.select(
        roles.entity,
        F.col("hist_avg_uptime").alias("avg_uptime_percentage"),
        F.col("hist_avg_downtime").alias("avg_downtime_minutes"),
        F.col("hist_avg_outage_count").alias("avg_outage_count"),
        F.col("hist_avg_users_affected").alias("avg_users_affected"),
        F.col("hist_pct_impactful").alias("pct_impactful"),
        F.col("hist_num_observations").alias("total_observations"),
    )


def add_components(rates: DataFrame) -> DataFrame:
    """Four risk components scaled to 0..1 over all entities; NULL where nothing varies.

    Minima and maxima are one row, so the cross join broadcasts one row. Pass materialised
    rates: they are read for the limits and again for the rows.
    """
    sources = {
        "norm_downtime_risk": ("avg_downtime_minutes", False),
        "norm_uptime_risk": ("avg_uptime_percentage", True),
        "norm_impact_risk": ("avg_users_affected", False),
        "norm_frequency_risk": ("pct_impactful", False),
    }
    limits = rates.agg(
        *[
            F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{name}")
            for name, (c, _) in sources.items()
        ]
    )

    def scaled(name: str, c: str, inverted: bool) -> Column:
        lo, hi = F.col(f"_{name}")["lo"], F.col(f"_{name}")["hi"]
        value = F.try_divide(F.col(c) - lo, hi - lo)
        return 1 - value if inverted else value

    return rates.crossJoin(F.broadcast(limits)).select(
        *rates.columns,
        *[scaled(name, c, inverted).alias(name) for name, (c, inverted) in sources.items()],
    )


def add_score(components: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of the components on a 0..100 scale."""
    weights = EQUAL_WEIGHTS if weights is None else weights
    total = None
    for name, weight in weights.items():
        part = F.lit(weight) * F.col(name)
        total = part if total is None else total + part
    return components.withColumn("site_reliability_risk_score", total * 100)


def score_quartiles(scored: DataFrame) -> DataFrame:
    """One row with the three quartiles of the score."""
    q = exact_quantiles(scored, ["site_reliability_risk_score"], [0.25, 0.5, 0.75])
    column = F.col("site_reliability_risk_score")
    return q.select(column[0].alias("q1"), column[1].alias("q2"), column[2].alias("q3"))


def add_category(scored: DataFrame) -> DataFrame:
    """Quarter of the score distribution an entity is in.

    Pass scores of materialised rates: they are read for the quartiles and again for the rows.
    """
    quartiles = score_quartiles(scored)
    category = at_most(
        F.col("site_reliability_risk_score"), [F.col("q1"), F.col("q2"), F.col("q3")], RISK_LEVELS
    )
    return scored.crossJoin(F.broadcast(quartiles)).select(
        *scored.columns, category.alias("risk_category_final")
    )


def bias_check(scored: DataFrame) -> DataFrame:
    """Mean score of entities seen once and of entities seen several times."""
    return scored.groupBy((F.col("total_observations") > 1).alias("is_multi_obs")).agg(
        F.count(F.lit(1)).alias("towers"),
        F.avg("site_reliability_risk_score").alias("avg_score"),
    )
