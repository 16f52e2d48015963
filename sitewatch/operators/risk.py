"""Preliminary rule-based risk of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatch.functions.bands import RISK_LEVELS
from sitewatch.functions.numeric import percent
from sitewatch.operators.quantiles import exact_quantiles
from sitewatch.roles import TOWERS, Roles

# Thresholds published for the first 31-day run.
PUBLISHED_THRESHOLDS = {
    "q1_avg_uptime": 89.44,
    "q3_total_downtime": 202.32,
    "q3_total_users": 410.0,
}


def summary_quartiles(summary: DataFrame) -> DataFrame:
    """One row: lower quartile of mean uptime, upper quartiles of downtime and users."""
    columns = ["avg_uptime_percentage", "total_downtime_minutes", "total_users_affected"]
    q = exact_quantiles(summary, columns, [0.25, 0.75])
    return q.select(
        F.col("avg_uptime_percentage")[0].alias("q1_avg_uptime"),
        F.col("total_downtime_minutes")[1].alias("q3_total_downtime"),
        F.col("total_users_affected")[1].alias("q3_total_users"),
    )


def add_risk(summary: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One point per condition met, and the category the points stand for.

    Thresholds are the quartiles of ``summary`` itself unless given. Computed thresholds are
    one row, so the cross join broadcasts one row. Pass a materialised ``summary`` to keep the
    quartiles from aggregating the observations a second time.
    """
    if thresholds is None:
        rows = summary.crossJoin(F.broadcast(summary_quartiles(summary)))
        limit = {name: F.col(name) for name in PUBLISHED_THRESHOLDS}
    else:
        rows = summary
        limit = {name: F.lit(thresholds[name]) for name in PUBLISHED_THRESHOLDS}

    def value(name: str):
        return F.col(name).cast("double")

    conditions = [
        value("avg_uptime_percentage") < limit["q1_avg_uptime"],
        value("total_downtime_minutes") > limit["q3_total_downtime"],
        value("total_users_affected") > limit["q3_total_users"],
        F.col("repeat_outage_indicator") == 1,
    ]
    points = sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0))
    category = F.array(*[F.lit(level) for level in RISK_LEVELS])
    return rows.select(*summary.columns, points.alias("risk_points")).withColumn(
        "site_risk_category_preliminary",
        F.get(category, F.least(F.col("risk_points"), F.lit(len(RISK_LEVELS) - 1))),
    )


def category_shares(
    df: DataFrame, category: str, name: str = "n", digits: int = 1
) -> DataFrame:
    """Count and percentage of every category, largest first.

    The total is summed over the category counts, of which there are a handful.
    """
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias(name))
    total = counts.agg(F.sum(name).alias("_total"))
    return (
        counts.crossJoin(F.broadcast(total))
        .select(category, name, percent(F.col(name), F.col("_total"), digits).alias("pct"))
        .orderBy(F.desc(name), F.col(category).asc_nulls_last())
    )


def risk_by_multiplicity(scored: DataFrame) -> DataFrame:
    """Category counts of entities seen with one and with several operators."""
    kind = F.when(F.col("distinct_operator_count") > 1, "Multi-operator tower").otherwise(
        "Single-operator tower"
    )
    return (
        scored.groupBy(kind.alias("tower_type"), "site_risk_category_preliminary")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("tower_type", "site_risk_category_preliminary")
    )


def attach_risk(rows: DataFrame, scored: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Repeat flag and category of the entity on each of its rows; NULL where it has none.

    ``scored`` has one row per entity, so an entity with very many rows makes only the left
    side of the join uneven, which adaptive execution splits.
    """
    flags = scored.select(
        roles.entity, "repeat_outage_indicator", "site_risk_category_preliminary"
    )
    return rows.join(flags, roles.entity, "left")
