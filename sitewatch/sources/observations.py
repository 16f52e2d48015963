"""Observation tables mapped from an event log.

The event log has ``event_id, ts, user_id, event_type, value, props``; the mapping gives
every event the columns of a site observation, first clean and typed, then as raw text with
the usual defects of such files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.sources.raw import RAW_COLUMNS


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Typed observations of the event log in ``folder``."""
    return from_events(spark.read.parquet(f"{folder}/events.parquet"))


def from_events(log: DataFrame) -> DataFrame:
    """Typed observations of an event log, batch or stream."""
    events = log.select(
        F.col("event_id"),
        F.col("user_id"),
        F.col("event_type"),
        F.col("ts").cast("date").alias("day"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        F.least(F.round(F.col("value") * 100).cast("bigint"), F.lit(21600)).alias("cents"),
    )

    def numbered(prefix: str, number: Column) -> Column:
        return F.concat(F.lit(prefix), number.cast("string"))

    user, event, k, cents = (F.col(c) for c in ("user_id", "event_id", "k", "cents"))
    lost = F.floor((cents * 10 + 72) / F.lit(144.0)).cast("bigint")
    reason = (
        F.when(F.col("event_type") == "click", "power_failure")
        .when(F.col("event_type") == "error", "equipment_fault")
        .when(F.col("event_type") == "purchase", "maintenance")
        .when(
            F.col("event_type") == "signup",
            F.when(k % 2 == 0, "fiber_cut").otherwise("weather"),
        )
    )
    return events.select(
        event.alias("row_id"),
        F.concat(
            F.lit("CT"), F.char((user % 15 + 65).cast("int")), F.lit("-"),
            (user * 100 + k).cast("string"),
        ).alias("tower_id"),
        F.col("day").alias("obs_date"),
        numbered("op_", event % 5).alias("operator"),
        numbered("city_", user % 15).alias("city"),
        numbered("state_", event % 37).alias("state"),
        ((10000 - lost) / F.lit(100.0)).cast("decimal(6,2)").alias("uptime_percentage"),
        (cents / F.lit(100.0)).cast("decimal(8,2)").alias("downtime_minutes"),
        (k % 6).alias("outage_count"),
        reason.alias("outage_reason"),
        F.concat((2 + (event + k) % 4).cast("string"), F.lit("G")).alias("network_type"),
        F.when(F.col("event_type") == "view", 0)
        .otherwise(1 + (event * 7) % 500)
        .cast("int")
        .alias("avg_users_affected"),
    )


def raw_observations(spark: SparkSession, folder: str) -> DataFrame:
    """The same observations as raw text, with defects at fixed row numbers and exact copies."""
    obs = observations(spark, folder)
    row = F.col("row_id")

    def every(step: int) -> Column:
        return row % step == 0

    text = {c: F.col(c).cast("string") for c in RAW_COLUMNS}
    damaged = dict(text)
    damaged["tower_id"] = (
        F.when(every(211), F.concat(F.lit("T"), "tower_id"))
        .when(every(193), F.concat(F.lit(" "), "tower_id"))
        .when(every(401), F.lit(None))
        .otherwise(text["tower_id"])
    )
    damaged["obs_date"] = (
        F.when(every(499), "2024-13-45").when(every(307), "01/02/2024").otherwise(text["obs_date"])
    )
    damaged["operator"] = (
        F.when(every(97), F.upper("operator"))
        .when(every(101), F.concat("operator", F.lit(" ")))
        .when(every(103), "  ")
        .otherwise(text["operator"])
    )
    damaged["city"] = F.when(every(89), F.upper("city")).otherwise(text["city"])
    damaged["uptime_percentage"] = (
        F.when(every(251), "n/a").when(every(257), "-1.5").when(every(263), "100.01")
        .otherwise(text["uptime_percentage"])
    )
    damaged["downtime_minutes"] = F.when(every(269), "-3").otherwise(text["downtime_minutes"])
    damaged["outage_count"] = F.when(every(271), "1.5").otherwise(text["outage_count"])
    damaged["outage_reason"] = F.when(every(277), "").otherwise(text["outage_reason"])
    damaged["network_type"] = F.when(every(281), F.lower("network_type")).otherwise(
        text["network_type"]
    )
    damaged["avg_users_affected"] = F.when(every(283), F.lit(None)).otherwise(
        text["avg_users_affected"]
    )
    first = obs.select(row, *[damaged[c].alias(c) for c in RAW_COLUMNS])
    copies = obs.where(every(331)).select(
        (row + 100000000).alias("row_id"), *[text[c].alias(c) for c in RAW_COLUMNS]
    )
    return first.unionByName(copies)
