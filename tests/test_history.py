from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sitewatch.operators import history
from sitewatch.operators.ordering import sorted_chunks
from sitewatch.sources.observations import observations

def same_rows(a, b):
    columns = sorted(a.columns)
    found, wanted = (
        sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) for df in (a, b)
    )
    return found == wanted


@pytest.fixture
def hot(spark, folder):
    """Observations with a third of all rows on one tower, several per day, some labels NULL."""
    df = observations(spark, folder)
    third = F.col("row_id") % 3 == 0
    return df.withColumn("tower_id", F.when(third, F.lit("CTA-0")).otherwise(F.col("tower_id"))).withColumn(
        "operator", F.when(F.col("row_id") % 11 != 0, F.col("operator"))
    )


ORDER = ["tower_id", "obs_date", "row_id"]


@pytest.fixture
def in_chunks(hot, many_partitions):
    return sorted_chunks(hot, [F.col(c) for c in ORDER])


def test_chunks_give_the_window_result(hot, in_chunks):
    assert same_rows(history.history_by_window(hot), history.history_by_chunks(in_chunks))


def test_both_ways_together_give_the_window_result(hot, in_chunks):
    across = [r[0] for r in history.crossing_entities(in_chunks).collect()]
    assert "CTA-0" in across and len(across) < 8
    assert same_rows(history.history_by_window(hot), history.history_features(hot))


def test_no_task_holds_a_hot_entity_even_with_hashed_row_numbers(hot, many_partitions):
    """A third of the rows are one tower's; row numbers are far apart."""
    rows = hot.withColumn("row_id", F.xxhash64("row_id"))
    chunks = sorted_chunks(rows, [F.col(c) for c in ORDER])
    total, hot_rows = rows.count(), rows.where("tower_id = 'CTA-0'").count()
    assert hot_rows > 0.3 * total
    largest = chunks.groupBy("_chunk", "tower_id").count().agg(F.max("count")).first()[0]
    assert largest < 0.2 * total and chunks.select("_chunk").distinct().count() > 4
    assert same_rows(history.history_by_window(rows), history.history_features(rows))


def test_rows_without_entity_count_for_nothing(make_obs):
    known = [{"tower_id": "AAA-1"}, {"tower_id": "AAA-1"}, {"tower_id": "AAA-2"}]
    unknown = [{"tower_id": None, "row_id": 90 + i} for i in range(3)]
    row = history.observation_counts(make_obs(known + unknown)).first()
    assert (row["modelable_towers"], row["single_observation_towers"]) == (1, 1)
    assert same_rows(
        history.history_features(make_obs(known)), history.history_features(make_obs(known + unknown))
    )


def test_no_example_sees_its_own_or_later_rows(make_obs):
    day = date(2025, 9, 1)
    rows = [
        {"obs_date": day + timedelta(days=i // 2), "avg_users_affected": i, "operator": f"o{i % 3}"}
        for i in range(10)
    ]
    whole = history.history_features(make_obs(rows))
    cut = history.history_features(make_obs(rows[:6]))
    assert same_rows(whole.where("row_id <= 6"), cut)
    assert whole.where("row_id = 1").count() == 0


def test_order_within_a_day_is_by_row(make_obs):
    rows = [{"city": "second", "row_id": 9}, {"city": "first", "row_id": 4}, {"row_id": 12}]
    got = {r["row_id"]: r["hist_city"] for r in history.history_features(make_obs(rows)).collect()}
    assert got == {9: "first", 12: "first"}


def test_mode_skips_missing_labels(make_obs):
    rows = [{"operator": o} for o in (None, None, "b", "a", "z")]
    got = {r["row_id"]: r["hist_mode_operator"] for r in history.history_features(make_obs(rows)).collect()}
    assert got == {2: None, 3: None, 4: "b", 5: "a"}


def test_latest_only(hot):
    latest = history.history_features(hot, latest_only=True)
    counts = hot.groupBy("tower_id").count().where("count > 1").count()
    assert latest.count() == counts
    every = history.history_features(hot)
    assert latest.select(*every.columns).exceptAll(every).count() == 0


def test_full_history_takes_last_known_uptime(make_obs):
    values = [Decimal("90.00"), Decimal("91.00"), None]
    row = history.full_history(make_obs([{"uptime_percentage": v} for v in values])).first()
    assert row["latest_uptime"] == Decimal("91.00")
    assert row["hist_num_observations"] == 3


def test_split_keeps_whole_days_together(spark):
    days = [date(2025, 9, d) for d in (1, 1, 1, 2, 2, 3, 3, 3, 4, 5)]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "target_date date, i int")
    split = history.time_split(df.repartition(4)).collect()
    assert {r["split_date"] for r in split} == {date(2025, 9, 4)}
    assert sum(r["is_test"] for r in split) == 2
    # Positional definition: the date at floor(0.8 n).
    assert sorted(days)[int(len(days) * 0.8)] == date(2025, 9, 4)


def test_both_ways_give_the_same_examples(spark, folder):
    rows = observations(spark, folder)
    wanted = history.history_by_window(rows)
    for most in (0, 3, 5, 1_000_000):
        assert same_rows(wanted, history.history_features(rows, hot_rows=most))
    assert history.hot_entities(rows, 1_000_000).count() == 0
    assert history.hot_entities(rows, 0).count() == rows.select("tower_id").distinct().count()


def test_the_window_is_the_only_shuffle_of_rows(spark, folder):
    """The counts and the hot entities are small; rows themselves are exchanged once."""
    text = history.history_by_window(observations(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in text
