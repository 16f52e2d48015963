from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sitewatch.operators import rollup
from sitewatch.sources import observations as source
from sitewatch.streaming import daily

TREND = ["observations", "total_outages", "total_downtime_minutes", "avg_uptime_pct"]


@pytest.fixture
def inbox(spark, tmp_path):
    """Delivers rows as files and lets the stream run over what is new; every run is a restart."""
    path, table, state = (str(tmp_path / n) for n in ("inbox", "table", "state"))

    def arrive(rows):
        rows.write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        return daily.follow_daily_trend(stream, table, state)

    return arrive, table


def test_trend_follows_arriving_files(spark, folder, inbox):
    events = spark.read.parquet(f"{folder}/events.parquet")
    arrive, table = inbox
    rows = source.from_events(events)
    middle = rows.agg(F.percentile_approx(F.unix_date("obs_date"), 0.5)).first()[0]
    arrive(rows.where(F.unix_date("obs_date") <= middle))
    arrive(rows.where(F.unix_date("obs_date") > middle))
    found, wanted = daily.read_daily_trend(spark, table), rollup.breakdown(rows, ["obs_date"], TREND)
    assert found.count() == wanted.count()
    assert found.select("obs_date", *TREND).exceptAll(wanted).count() == 0
    # All days but those within the delay of the last one are closed.
    last = rows.agg(F.max("obs_date")).first()[0]
    still_open = {r["obs_date"] for r in found.where("NOT closed").collect()}
    assert still_open and min(still_open) >= last - timedelta(days=3)
    assert daily.rejected_rows(spark, table).count() == 0


def test_late_rows_are_rejected_and_counted_once(spark, make_obs, inbox):
    arrive, table = inbox

    def on(*days, outages=1):
        return make_obs([{"obs_date": date(2025, 9, d), "outage_count": outages} for d in days])

    def trend():
        return {r["obs_date"].day: (r["observations"], r["total_outages"], r["closed"])
                for r in daily.read_daily_trend(spark, table).collect()}

    arrive(on(1, 1, 2))
    assert trend() == {1: (2, 2, False), 2: (1, 1, False)}
    arrive(on(1, 9))  # late, but within its open day; then the ninth closes the first days
    assert trend() == {1: (3, 3, True), 2: (1, 1, True), 9: (1, 1, False)}
    before = _files(table)
    arrive(on(1, 1, 2, 8, outages=5))  # beyond the watermark, but for the eighth
    assert trend() == {1: (3, 3, True), 2: (1, 1, True), 8: (1, 5, False), 9: (1, 1, False)}
    rejected = {r["obs_date"].day: r["late_observations"] for r in daily.rejected_rows(spark, table).collect()}
    assert rejected == {1: 2, 2: 1}
    assert before <= _files(table)  # closed days are not written again
    arrive(on(20))
    assert trend()[8] == (1, 5, True) and trend()[9] == (1, 1, True)


def test_open_days_are_all_that_is_kept(make_obs, inbox):
    arrive, _ = inbox
    for day in (1, 8, 15, 22, 29):
        closing, _ = arrive(make_obs([{"obs_date": date(2025, 9, d)} for d in (day, day + 1)]))
        assert closing.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_rows_without_a_day_never_close(spark, make_obs, inbox):
    arrive, table = inbox
    arrive(make_obs([{"obs_date": None}, {"obs_date": date(2025, 9, 1)}]))
    arrive(make_obs([{"obs_date": None}, {"obs_date": date(2025, 9, 30)}]))
    found = {r["obs_date"]: (r["observations"], r["closed"]) for r in daily.read_daily_trend(spark, table).collect()}
    assert found == {None: (2, False), date(2025, 9, 1): (1, True), date(2025, 9, 30): (1, False)}


def _files(table):
    from pathlib import Path

    return {(p.name, p.stat().st_mtime_ns) for p in Path(table, "closed").glob("*.parquet")}
