from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sitewatch.functions import bands, numeric, text
from sitewatch.functions.calendar import calendar_columns
from sitewatch.operators import distribution, features, rollup, watchlist


def test_calendar_at_year_and_quarter_ends(spark):
    days = [date(2024, 12, 29), date(2024, 12, 30), date(2025, 3, 31), date(2026, 1, 1), date(2025, 9, 6)]
    df = spark.createDataFrame([(d,) for d in days], "obs_date date")
    rows = {r["obs_date"]: r for r in features.add_calendar(df).collect()}
    for d in days:
        year, week, weekday = d.isocalendar()
        assert rows[d]["obs_week_number"] == week
        assert rows[d]["obs_day_of_week_number"] == weekday
        assert rows[d]["obs_year"] == d.year
        assert rows[d]["obs_quarter"] == (d.month + 2) // 3
        assert rows[d]["obs_month_name"] == d.strftime("%B")
        assert rows[d]["obs_day_of_week_name"] == d.strftime("%A")
        assert rows[d]["is_weekend"] == (weekday >= 6)
    assert list(calendar_columns(F.col("obs_date")))[0] == "obs_year"


@pytest.mark.parametrize(
    "uptime,label,risk",
    [("99.00", "Excellent", 0), ("98.99", "Good", 0), ("95.00", "Good", 0), ("94.99", "Fair", 1),
     ("90.00", "Fair", 1), ("89.99", "Poor", 1), (None, "Poor", 0)],
)
def test_reliability_limits(make_obs, uptime, label, risk):
    value = None if uptime is None else Decimal(uptime)
    row = features.add_row_features(make_obs([{"uptime_percentage": value}])).first()
    assert row["reliability_status"] == label
    assert row["high_risk_flag"] == risk


@pytest.mark.parametrize(
    "minutes,count,label",
    [("120.00", 0, "High"), ("0.00", 4, "High"), ("119.99", 3, "Medium"), ("60.00", 0, "Medium"),
     ("0.00", 2, "Medium"), ("59.99", 1, "Low"), (None, None, "Low"), (None, 5, "High")],
)
def test_severity_limits(make_obs, minutes, count, label):
    value = None if minutes is None else Decimal(minutes)
    df = make_obs([{"downtime_minutes": value, "outage_count": count}])
    assert features.add_row_features(df).first()["outage_severity"] == label


def test_hours_round_half_away_from_zero(make_obs):
    # 0.33 minutes are 0.0055 hours; 2.01 are 0.0335; 100.23 are 1.6705.
    df = features.add_row_features(
        make_obs([{"downtime_minutes": Decimal(m)} for m in ("0.33", "2.01", "100.23", "0.15")])
    )
    got = sorted(r["downtime_hours"] for r in df.collect())
    assert got == [Decimal("0.0025"), Decimal("0.0055"), Decimal("0.0335"), Decimal("1.6705")]


def test_rounded_mean_keeps_exact_ties(make_obs):
    df = make_obs([{"uptime_percentage": Decimal("92.10")}, {"uptime_percentage": Decimal("92.11")}])
    row = df.agg(numeric.rounded_mean("uptime_percentage", 2).alias("m")).first()
    assert row["m"] == Decimal("92.11")


def test_correlation_without_spread_is_null(make_obs):
    df = make_obs([{"avg_users_affected": 1}, {"avg_users_affected": 2}])
    row = df.agg(
        numeric.pearson("uptime_percentage", "avg_users_affected").alias("constant"),
        numeric.pearson("row_id", "avg_users_affected").alias("r"),
    ).first()
    assert row["constant"] is None
    assert abs(row["r"]) == pytest.approx(1)


def test_correlation_skips_incomplete_pairs(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 100.0), (50.0, None)], "x double, y double"
    )
    whole = df.dropna().agg(F.corr("x", "y")).first()[0]
    assert df.agg(numeric.pearson("x", "y")).first()[0] == pytest.approx(whole, abs=1e-12)


def test_probability_bands_are_right_closed(spark):
    df = spark.createDataFrame(
        [(p,) for p in (0.0, 0.25, 0.2500001, 0.5, 0.75, 0.7500001, 1.0, None)], "p double"
    )
    got = [r[1] for r in watchlist.add_band(df, "p").collect()]
    assert got == ["Low", "Low", "Medium", "Medium", "High", "Critical", "Critical", None]


def test_trim_removes_spaces_only(spark):
    df = spark.createDataFrame([(" a ",), ("\ta",), ("a",), (None,)], "x string")
    assert [r[0] for r in df.select(text.is_padded("x")).collect()] == [True, False, False, None]


def test_width_bucket_overflow(make_obs):
    df = make_obs([{"uptime_percentage": Decimal(u)} for u in ("100.00", "85.00", "84.99", "99.99")])
    got = distribution.bucket_counts(df, F.col("uptime_percentage").cast("double"), 85.0, 100.0, 15)
    assert {r["bucket"]: r["n"] for r in got.collect()} == {0: 1, 1: 1, 15: 1, 16: 1}


def test_histogram_matches_numpy(spark, folder):
    import numpy as np

    from sitewatch.sources.observations import observations

    df = observations(spark, folder)
    values = [float(r[0]) for r in df.select("downtime_minutes").collect()]
    counts, _ = np.histogram(values, bins=30)
    got = {r["bin"]: r["n"] for r in distribution.histograms(df, {"downtime_minutes": 30}).collect()}
    assert [got.get(i, 0) for i in range(30)] == counts.tolist()


def test_histogram_of_whole_numbers_lists_empty_bins(make_obs):
    df = make_obs([{"outage_count": n} for n in (0, 1, 1, 7, None)])
    got = distribution.histograms(df, {"outage_count": None}).collect()
    assert {r["bin"]: r["n"] for r in got} == {0: 1, 1: 2, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1}


def test_histogram_with_a_far_value(spark):
    """Bins beyond the range of an int, and empty ones made by more than one task."""
    far = 3_000_000_000
    df = spark.createDataFrame([(float(v),) for v in (-5, 0, 0, far)], "x double")
    got = distribution.histograms(df, {"x": None}, empty=False).collect()
    assert {r["bin"]: r["n"] for r in got} == {0: 1, 5: 2, far + 5: 1}
    near = distribution.histograms(df.where(f"x < {far}").union(spark.sql("SELECT 1e6")), {"x": None})
    tasks = near.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    made = [r["n"] for r in tasks.collect()]
    assert sum(made) == 1_000_006 and len(made) > 1
    assert near.agg(F.sum("n"), F.countDistinct("bin"), F.max("bin")).first()[:] == (4, 1_000_006, 1_000_005)


def test_histogram_of_constant_measure(make_obs):
    got = distribution.histograms(make_obs([{}, {}]), {"outage_count": None}).collect()
    assert [(r["bin"], r["n"]) for r in got] == [(0, 2)]


def test_spread_check_against_plain_aggregates(spark, folder):
    from sitewatch.sources.observations import observations

    df = observations(spark, folder)
    row = rollup.spread_check(df, "operator", "uptime_percentage", ("range", "sd"), 6).first()
    sd = df.agg(F.stddev_samp(F.col("uptime_percentage").cast("double"))).first()[0]
    means = [r[1] for r in df.groupBy("operator").agg(numeric.mean("uptime_percentage")).collect()]
    assert float(row["sd"]) == pytest.approx(sd, abs=1e-6)
    assert float(row["range"]) == pytest.approx(max(means) - min(means), abs=1e-6)


def test_listed_causes_keep_unseen_ones(make_obs):
    df = make_obs([{"outage_reason": "weather"}, {"outage_reason": None}])
    rows = rollup.listed_causes(df, ["fiber_cut", "weather"]).collect()
    assert [(r["outage_reason"], r["n"]) for r in rows] == [("fiber_cut", None), ("weather", 1)]


def test_severity_order(make_obs):
    df = features.add_row_features(make_obs([{"outage_count": c} for c in (0, 2, 4)]).withColumn(
        "downtime_minutes", F.lit(0).cast("decimal(8,2)")))
    rows = rollup.severity_mix(df, "operator").collect()
    assert [r["outage_severity"] for r in rows] == list(bands.SEVERITY_ORDER)
