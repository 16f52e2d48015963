"""Row-level features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.functions import bands
from sitewatch.functions.calendar import calendar_columns
from sitewatch.roles import TOWERS, Roles
from sitewatch.sources.raw import FEATURE_EXPORT_SCHEMA

# Columns of the feature export, in order.
EXPORT_COLUMNS = tuple(column.split()[0] for column in FEATURE_EXPORT_SCHEMA.split(", "))


def add_calendar(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    return df.withColumns(calendar_columns(F.col(roles.day)))


def high_risk(roles: Roles = TOWERS) -> Column:
    return F.when(F.col(roles.uptime) < bands.HIGH_RISK_UPTIME, 1).otherwise(0)


def add_row_features(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Reliability band, high-risk flag, hours of downtime, month and weekday, severity."""
    day = F.col(roles.day)
    return df.withColumns(
        {
            "reliability_status": bands.at_least(
                F.col(roles.uptime), bands.RELIABILITY_BANDS, bands.RELIABILITY_REST
            ),
            "high_risk_flag": high_risk(roles),
            "downtime_hours": F.round(F.col(roles.downtime) / 60, 4).cast("decimal(12,4)"),
            "observation_month": F.date_format(day, "yyyy-MM"),
            "day_of_week": F.date_format(day, "EEEE"),
            "outage_severity": bands.severity(F.col(roles.downtime), F.col(roles.outages)),
        }
    )


def features(clean_rows: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """The full row-level feature table."""
    return add_row_features(add_calendar(clean_rows, roles), roles)


def counts_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key combination, NULL included."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
