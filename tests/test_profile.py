from __future__ import annotations

from pyspark.sql import functions as F

from sitewatch.operators import profile


def test_sketches_of_days_unite(spark):
    """Values that recur on many days count once; a range of days is answered from its sketches."""
    rows = spark.range(40_000).select(
        (F.col("id") % 20).alias("day"), (F.col("id") % 20_000).cast("string").alias("tower")
    )
    sketches = profile.distinct_sketches(rows, ["day"], "tower")
    assert sketches.count() == 20
    whole = profile.distinct_estimate(sketches, "n").first()["n"]
    assert abs(whole - 20_000) <= 0.05 * 20_000
    week = profile.distinct_estimate(sketches.where("day < 7"), "n").first()["n"]
    assert abs(week - 7_000) <= 0.05 * 7_000
    halves = profile.distinct_estimate(sketches.withColumn("half", F.col("day") % 2), "n", ["half"]).collect()
    assert all(abs(r["n"] - 10_000) <= 500 for r in halves) and len(halves) == 2


def test_no_values_are_none(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (2, "a")], "day int, tower string")
    sketches = profile.distinct_sketches(rows, ["day"], "tower")
    assert {r["day"]: r["n"] for r in profile.distinct_estimate(sketches, "n", ["day"]).collect()} == {1: 0, 2: 1}
