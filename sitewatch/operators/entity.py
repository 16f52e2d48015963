"""One row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.functions.numeric import rounded_mean
from sitewatch.roles import TOWERS, Roles


# The highest code point stands for a missing label: it sorts after every real one.
_MISSING = "\U0010ffff"


def most_frequent(column: str) -> Column:
    """Most frequent text of a group; ties go to the first in sort order.

    NULL counts as a value and sorts last, which is what a frequency table ordered by count
    and value would put on top.
    """
    return F.nullif(F.mode(F.coalesce(column, F.lit(_MISSING)), True), F.lit(_MISSING))


def different(column: str) -> Column:
    """Number of different known values of a low-cardinality attribute in a group."""
    return F.size(F.collect_set(column)).cast("bigint")


def entity_modes(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    return df.groupBy(roles.entity).agg(
        *[most_frequent(c).alias(f"mode_{c}") for c in roles.labels]
    )


def _aggregates(roles: Roles) -> dict[str, Column]:
    columns = {
        "city": F.min(roles.place),
        "total_observations": F.count(F.lit(1)),
        "avg_uptime_percentage": rounded_mean(roles.uptime, 2).cast("decimal(6,2)"),
        "total_downtime_minutes": F.sum(roles.downtime),
        "total_outage_count": F.sum(roles.outages),
        "total_users_affected": F.sum(roles.users),
        "impactful_outage_observations": F.count_if(F.col(roles.users) > 0),
    }
    for c in roles.labels:
        columns[f"distinct_{c}_count"] = different(c)
    return columns


def entity_totals(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    return df.groupBy(roles.entity).agg(*[c.alias(n) for n, c in _aggregates(roles).items()])


def entity_summary(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Totals, label modes and label multiplicity of every entity.

    One aggregation, one shuffle: modes and distinct sets are kept next to the sums, so the
    frequency tables need no scans and joins of their own. Every part of the state is merged
    before the shuffle, so an entity with very many rows costs no more than any other; the
    modes and sets hold the few values of low-cardinality labels. Rows without an entity
    belong to none.
    """
    columns = _aggregates(roles)
    for c in roles.labels:
        columns[f"mode_{c}"] = most_frequent(c)
    ordered = [
        "city",
        *[x for c in roles.labels for x in (f"mode_{c}", f"distinct_{c}_count")],
        "total_observations", "avg_uptime_percentage", "total_downtime_minutes",
        "total_outage_count", "total_users_affected", "impactful_outage_observations",
    ]
    known = df.where(F.col(roles.entity).isNotNull())
    summary = known.groupBy(roles.entity).agg(*[columns[n].alias(n) for n in ordered])
    return summary.withColumn(
        "repeat_outage_indicator",
        F.when(F.col("impactful_outage_observations") > 1, 1).otherwise(0),
    )
