"""Breakdowns of observations and entities by operator, place, cause and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.functions import numeric
from sitewatch.functions.bands import severity_rank
from sitewatch.roles import TOWERS, Roles


def metrics(roles: Roles = TOWERS) -> dict[str, Column]:
    """Aggregate expressions the breakdowns choose from, by output name."""
    rows = F.count(F.lit(1))
    users_hit = F.count_if(F.col(roles.users) > 0)
    with_reason = F.count_if(F.col(roles.reason).isNotNull())
    return {
        "n": rows,
        "observations": rows,
        "distinct_towers_seen": F.count_distinct(roles.entity),
        "unique_towers": F.count_distinct(roles.entity),
        "avg_uptime_pct": numeric.rounded_mean(roles.uptime, 2),
        "avg_downtime_minutes": numeric.rounded_mean(roles.downtime, 2),
        "avg_outage_count": numeric.rounded_mean(roles.outages, 2),
        "avg_users_affected": numeric.rounded_mean(roles.users, 1),
        "total_downtime_minutes": F.round(F.sum(roles.downtime), 1),
        "total_outages": F.sum(roles.outages),
        "total_users_affected": F.sum(roles.users),
        "users_hit": users_hit,
        "pct_users_hit": numeric.percent(users_hit, rows, 2),
        "with_reason": with_reason,
        "pct_with_reason": numeric.percent(with_reason, rows, 2),
        "mean_uptime": numeric.mean(roles.uptime),
        "mean_downtime": numeric.mean(roles.downtime),
        "sum_downtime": F.sum(roles.downtime),
        "first_day": F.min(roles.day),
        "last_day": F.max(roles.day),
    }


def breakdown(
    df: DataFrame,
    by: Sequence[str],
    wanted: Sequence[str] | dict[str, str],
    where: Column | None = None,
    roles: Roles = TOWERS,
) -> DataFrame:
    """Chosen ``metrics`` per group; a dict renames them (output name to metric)."""
    names = wanted if isinstance(wanted, dict) else {name: name for name in wanted}
    available = metrics(roles)
    rows = df if where is None else df.where(where)
    return rows.groupBy(*by).agg(*[available[m].alias(name) for name, m in names.items()])


def top_n(
    df: DataFrame, order: str, n: int, tie: Sequence[str], ascending: bool = False
) -> DataFrame:
    """The ``n`` first rows by ``order``; ``tie`` columns make the choice reproducible."""
    column = F.col(order)
    first = column.asc_nulls_last() if ascending else column.desc_nulls_first()
    return df.orderBy(first, *[F.col(t).asc_nulls_last() for t in tie]).limit(n)


def severity_mix(df: DataFrame, by: str, where: Column | None = None) -> DataFrame:
    """Rows per group and severity, most severe first within a group."""
    rows = df if where is None else df.where(where)
    return (
        rows.groupBy(by, "outage_severity")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col(by).asc_nulls_last(), severity_rank(F.col("outage_severity")))
    )


def spread_check(
    df: DataFrame,
    by: str,
    measure: str,
    names: tuple[str, str],
    digits: int = 3,
    where: Column | None = None,
) -> DataFrame:
    """Range of the group means next to the overall standard deviation of the measure.

    Each group carries its count, sum and sum of squares, so the overall deviation comes from
    the groups and the rows are read once.
    """
    rows = df if where is None else df.where(where)
    groups = rows.groupBy(by).agg(
        F.count(measure).alias("n"),
        F.sum(measure).alias("total"),
        F.sum(numeric.square(measure)).alias("squares"),
    )
    group_mean = F.try_divide(F.col("total").cast("decimal(24,4)"), F.col("n"))
    deviation = numeric.stddev_from_sums(F.sum("n"), F.sum("total"), F.sum("squares"))
    return groups.agg(
        F.round(F.max(group_mean) - F.min(group_mean), digits).alias(names[0]),
        F.round(deviation, digits).alias(names[1]),
    )


def daily_spread(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Range and standard deviation of the daily mean uptimes."""
    daily = df.groupBy(roles.day).agg(numeric.mean(roles.uptime).alias("m"))
    return daily.agg(
        (F.max("m") - F.min("m")).alias("range_of_daily_avg_uptime"),
        F.stddev_samp("m").alias("stddev_of_daily_avgs"),
    )


def overview(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Network totals and averages in one row."""
    return breakdown(
        df, [],
        {
            "unique_towers": "unique_towers",
            "total_observations": "observations",
            "total_outages": "total_outages",
            "total_downtime_minutes": "total_downtime_minutes",
            "avg_uptime_pct": "avg_uptime_pct",
            "avg_downtime_minutes": "avg_downtime_minutes",
            "avg_outage_count": "avg_outage_count",
            "total_users_affected": "total_users_affected",
            "avg_users_affected_per_obs": "avg_users_affected",
            "outage_affected_observations": "users_hit",
            "pct_obs_with_impact": "pct_users_hit",
        },
        roles=roles,
    )


def entity_overview(summary: DataFrame) -> DataFrame:
    """Averages of per-entity ratios, which do not favour entities with many rows."""
    seen = F.col("total_observations")
    repeat = F.count_if(F.col("repeat_outage_indicator") == 1)
    ratio = "decimal(18,10)"
    return summary.agg(
        F.count(F.lit(1)).alias("towers"),
        numeric.rounded_mean("avg_uptime_percentage", 2).alias("avg_tower_uptime_pct"),
        _mean_of((F.col("total_downtime_minutes") / seen).cast(ratio)).alias(
            "avg_downtime_per_observation"
        ),
        _mean_of((F.col("total_outage_count").cast("decimal(20,0)") / seen).cast(ratio)).alias(
            "avg_outage_count_per_observation"
        ),
        repeat.alias("repeat_outage_towers"),
        numeric.percent(repeat, F.count(F.lit(1)), 2).alias("pct_repeat_outage_towers"),
    )


def _mean_of(value: Column) -> Column:
    return F.round(F.try_divide(F.sum(value), F.count(value)), 2)


def place_impact(summary: DataFrame, limit: int = 10) -> DataFrame:
    """Places whose entities affect the most users."""
    per_place = summary.groupBy("city").agg(
        F.sum("total_users_affected").alias("total_users_affected"),
        F.count(F.lit(1)).alias("towers"),
        numeric.rounded_mean("total_users_affected", 1).alias("avg_users_affected_per_tower"),
    )
    return top_n(per_place, "total_users_affected", limit, ["city"])


def recurring_causes(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Entities on which the same cause occurs more than once, per cause."""
    repeated = (
        df.where(F.col(roles.reason).isNotNull())
        .groupBy(roles.entity, roles.reason)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )
    return (
        repeated.groupBy(roles.reason)
        .agg(F.count(F.lit(1)).alias("tower_occurrences"))
        .orderBy(F.desc("tower_occurrences"), roles.reason)
    )


def listed_causes(df: DataFrame, causes: Sequence[str], roles: Roles = TOWERS) -> DataFrame:
    """Totals per cause for a fixed list of causes in list order; unseen causes stay, as NULL."""
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(cause).alias(roles.reason))
        for i, cause in enumerate(causes)
    ]
    wanted = df.sparkSession.range(1).select(F.inline(F.array(*entries)))
    totals = breakdown(
        df, [roles.reason],
        {"n": "n", "total_downtime": "sum_downtime", "total_users": "total_users_affected"},
        where=F.col(roles.reason).isNotNull(),
        roles=roles,
    )
    return wanted.join(totals, roles.reason, "left").orderBy("position")


def headline_check(df: DataFrame, expected: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """The four headline figures next to the one-row table of expected figures."""
    found = df.agg(
        numeric.rounded_mean(roles.uptime, 2).alias("avg_uptime_pct"),
        F.round(F.sum(roles.downtime), 1).alias("total_downtime"),
        F.sum(roles.outages).alias("total_outages"),
        F.sum(roles.users).alias("total_users_affected"),
    )
    both = found.crossJoin(
        F.broadcast(expected.select(*[F.col(c).alias(f"_{c}") for c in found.columns]))
    )
    return both.select(
        *found.columns,
        *[
            (F.col(c).cast("double") == F.col(f"_{c}").cast("double")).alias(f"{c}_ok")
            for c in found.columns
        ],
    )
