"""Physical plans: what is shuffled, pruned, split and kept in the JVM."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sitewatch.operators import dashboard, entity, history, rollup
from sitewatch.operators.risk import PUBLISHED_THRESHOLDS, add_risk, attach_risk
from sitewatch.plans import catalog
from sitewatch.sources.observations import observations
from sitewatch.sources.scratch import frozen


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    "dq_nulls", "dq_casefold", "dq_dup_rows", "out_value_counts", "out_histograms", "stg_clean",
    "ent_summary", "biz_operator", "biz_operator_spread", "biz_cause_recurring", "biz_daily",
    "ml_history", "score_rates", "wl_full_history", "dash_legends",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_in_the_plan(spark, folder, name):
    text = plan(catalog.CATALOG[name](spark, folder))
    assert not re.search("EvalPython|InPandas|InArrow|PythonUDF", text)


def test_summary_shuffles_once(spark, folder):
    text = plan(entity.entity_summary(observations(spark, folder)))
    assert text.count("Exchange") == 1
    assert "partial_" in text


def test_history_is_one_window_and_one_shuffle(spark, folder):
    text = plan(history.history_by_window(observations(spark, folder)))
    assert text.count("Exchange") == 1
    assert "SinglePartition" not in text
    assert len(re.findall(r"\+?- ?.*Window \[", text)) <= 1


def test_spread_reads_the_rows_once(spark, folder):
    text = plan(catalog.CATALOG["biz_operator_spread"](spark, folder))
    assert text.count("FileScan") == 1


def test_only_needed_columns_are_read(spark, folder):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(
        rollup.breakdown(observations(spark, folder), ["operator"], ["n"]))).group(1)
    assert schema == "event_id:bigint"


def test_top_n_is_not_a_full_sort(spark, folder):
    assert "TakeOrderedAndProject" in plan(catalog.CATALOG["biz_state_outages"](spark, folder))


def test_split_date_filter_reaches_the_files(spark, folder):
    from sitewatch.plans import stages

    train, _ = stages.train_and_test(observations(spark, folder))
    assert "LessThan(target_date" in plan(train)


def test_small_dictionary_is_broadcast_by_its_size(spark, folder):
    df = observations(spark, folder)
    text = plan(dashboard.observation_cube(df, dashboard.materialised_legends(df)))
    assert text.count("BroadcastHashJoin") == 6
    assert "SortMergeJoin" not in text


def test_large_dictionary_is_joined_by_shuffle(spark, folder):
    df = observations(spark, folder)
    dictionary = dashboard.materialised_legends(df)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        cube = dashboard.observation_cube(df, dictionary)
        assert "BroadcastHashJoin" not in plan(cube)
        rows = cube.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(rows) == df.count()
    assert all(r["op"] is not None and r["rs"] is not None for r in rows)


def test_one_large_dimension_leaves_the_other_joins_broadcast(spark, folder):
    df = observations(spark, folder)
    dictionary = dict(dashboard.materialised_legends(df))
    more = spark.range(200_000).selectExpr("CAST(id + 1000 AS INT) AS code", "uuid() AS value")
    dictionary["cities"] = frozen(dictionary["cities"].unionByName(more))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    try:
        text = plan(dashboard.observation_cube(df, dictionary))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("BroadcastHashJoin") == 5 and text.count("SortMergeJoin") == 1


def test_hot_tower_is_split_in_the_back_join(spark, folder):
    df = frozen(
        observations(spark, folder)
        .crossJoin(spark.range(20).withColumnRenamed("id", "copy"))
        .withColumn("tower_id", F.when(F.col("copy") % 3 == 0, "CTA-0").otherwise(F.col("tower_id")))
        .repartition(16)
    )
    scored = frozen(add_risk(entity.entity_summary(df), PUBLISHED_THRESHOLDS))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = attach_risk(df, scored)
        rows = joined.collect()
        final = plan(joined)
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert "skew=true" in final
    assert len(rows) == 20000
    assert all(r["repeat_outage_indicator"] is not None for r in rows)
