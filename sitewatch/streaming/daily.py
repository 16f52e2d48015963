"""The daily trend kept up to date from a stream of observation files.

Two queries follow the files. One counts event-time windows of a day and appends each day once,
when the watermark has passed it; its state holds the open days only. The other adds what every
batch brought to a log, a row for each day in it. What the log has of a closed day beyond the
appended row came too late.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sitewatch.roles import TOWERS, Roles

DELAY = "2 days"  # a day stays open until a row this much later than its end has come
_DAY_SECONDS = 86_400
# What is kept of a day: exact sums, from which the figures follow.
_KEPT = {
    "observations": "bigint", "outages": "bigint", "downtime": "decimal(28,2)",
    "uptime": "decimal(28,2)", "uptime_known": "bigint",
}


def _moment(day: Column) -> Column:
    """Midnight of a date in UTC, whatever the session's time zone."""
    return F.timestamp_seconds(F.unix_date(day) * _DAY_SECONDS)


def _sums(roles: Roles) -> list[Column]:
    found = (
        F.count(F.lit(1)), F.sum(roles.outages), F.sum(roles.downtime), F.sum(roles.uptime), F.count(roles.uptime),
    )
    return [f.cast(kind).alias(name) for f, (name, kind) in zip(found, _KEPT.items())]


def closing_days(stream: DataFrame, roles: Roles = TOWERS, delay: str = DELAY) -> DataFrame:
    """Sums of each day, in append mode one row when the watermark has passed its end.

    Rows of days that are closed already are dropped; rows without a day belong to none.
    """
    timed = stream.withColumn("_at", _moment(F.col(roles.day))).withWatermark("_at", delay)
    days = timed.groupBy(F.window("_at", "1 day").alias("_window")).agg(*_sums(roles))
    start = F.unix_seconds(F.col("_window.start"))
    day = F.date_from_unix_date((start / _DAY_SECONDS).cast("int"))
    return days.select(day.alias(roles.day), *_KEPT)


def follow_daily_trend(
    stream: DataFrame, path: str, checkpoint_path: str, roles: Roles = TOWERS, delay: str = DELAY
) -> Iterable[StreamingQuery]:
    """Process the files that have arrived, then stop; run again for more.

    Both queries run to their end, the one that closes days first, and are given back. Below
    ``path``: ``closed`` is only appended to, by a sink whose log counts every batch once, and
    ``arrived`` has a folder for each batch, which a repeated batch replaces.
    """

    def log(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy(roles.day).agg(*_sums(roles))
        counted.write.mode("overwrite").parquet(f"{path}/arrived/batch={number}")

    closing = (
        closing_days(stream, roles, delay)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/closed")
        .option("checkpointLocation", f"{checkpoint_path}/closed")
        .trigger(availableNow=True)
        .start()
    )
    closing.awaitTermination()
    arriving = (
        stream.writeStream.foreachBatch(log)
        .option("checkpointLocation", f"{checkpoint_path}/arrived")
        .trigger(availableNow=True)
        .start()
    )
    arriving.awaitTermination()
    return closing, arriving


def _schema(roles: Roles) -> T.StructType:
    fields = ", ".join(f"{name} {kind}" for name, kind in _KEPT.items())
    return T.StructType([T.StructField(roles.day, T.DateType()), *T._parse_datatype_string(fields).fields])


def _closed(spark: SparkSession, path: str, roles: Roles) -> DataFrame:
    return spark.read.schema(_schema(roles)).parquet(f"{path}/closed")


def _arrived(spark: SparkSession, path: str, roles: Roles) -> DataFrame:
    log = spark.read.schema(_schema(roles)).parquet(f"{path}/arrived/batch=*")
    return log.groupBy(roles.day).agg(*[F.sum(n).cast(k).alias(n) for n, k in _KEPT.items()])


def read_daily_trend(spark: SparkSession, path: str, roles: Roles = TOWERS) -> DataFrame:
    """The trend so far: closed days as they were appended, the others, those without a day
    too, by what has arrived. ``closed`` tells which; a closed day never changes again."""
    closed = _closed(spark, path, roles).withColumn("closed", F.lit(True))
    shut = closed.select(roles.day)  # one row per day
    still = _arrived(spark, path, roles).join(shut, roles.day, "left_anti").withColumn("closed", F.lit(False))
    mean = F.try_divide(F.col("uptime").cast("decimal(24,4)"), F.col("uptime_known"))
    return closed.unionByName(still).select(
        roles.day,
        "observations",
        F.col("outages").alias("total_outages"),
        F.round("downtime", 1).alias("total_downtime_minutes"),
        F.round(mean, 2).alias("avg_uptime_pct"),
        "closed",
    )


def rejected_rows(spark: SparkSession, path: str, roles: Roles = TOWERS) -> DataFrame:
    """Closed days that rows came too late for, and how many did: ``late_observations``."""
    closed = _closed(spark, path, roles).select(roles.day, F.col("observations").alias("counted"))
    late = _arrived(spark, path, roles).join(closed, roles.day)
    return late.select(roles.day, (F.col("observations") - F.col("counted")).alias("late_observations")).where(
        "late_observations > 0"
    )
