from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def many_partitions(spark):
    """Small tables sorted over several partitions, as large ones are."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


@pytest.fixture
def folder():
    return SMALL


OBS_SCHEMA = (
    "row_id bigint, tower_id string, obs_date date, operator string, city string, state string, "
    "uptime_percentage decimal(6,2), downtime_minutes decimal(8,2), outage_count int, "
    "outage_reason string, network_type string, avg_users_affected int"
)


@pytest.fixture
def make_obs(spark):
    """Observations from short dicts; what is left out gets a default."""
    from datetime import date
    from decimal import Decimal

    def build(rows, partitions=3):
        full = []
        for i, r in enumerate(rows, start=1):
            base = {
                "row_id": i, "tower_id": "AAA-1", "obs_date": date(2025, 9, 1), "operator": "op",
                "city": "c", "state": "s", "uptime_percentage": Decimal("97.00"),
                "downtime_minutes": Decimal("43.20"), "outage_count": 1,
                "outage_reason": "weather", "network_type": "4G", "avg_users_affected": 10,
            }
            base.update(r)
            full.append(tuple(base.values()))
        return spark.createDataFrame(full, OBS_SCHEMA).repartition(partitions)

    return build
