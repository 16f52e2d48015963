from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sitewatch.operators import dashboard, entity, history, quality, risk, rollup, score, watchlist
from sitewatch.plans import stages
from sitewatch.roles import Roles
from sitewatch.sources.observations import observations, raw_observations
from sitewatch.sources.scratch import frozen


def test_mode_ties_take_the_first_label(make_obs):
    df = make_obs([{"operator": o} for o in ("b", "a", "b", "a", "c")])
    assert entity.entity_summary(df).first()["mode_operator"] == "a"


def test_missing_label_wins_when_most_frequent_and_loses_ties(make_obs):
    df = make_obs(
        [{"operator": o, "tower_id": "AAA-1"} for o in (None, None, "z")]
        + [{"operator": o, "tower_id": "AAA-2"} for o in (None, "z")]
    )
    got = {r["tower_id"]: r for r in entity.entity_summary(df).collect()}
    assert got["AAA-1"]["mode_operator"] is None
    assert got["AAA-2"]["mode_operator"] == "z"
    assert got["AAA-1"]["distinct_operator_count"] == 1


def test_rows_without_entity_are_in_no_summary(make_obs):
    df = make_obs([{"tower_id": None}, {"tower_id": "AAA-1"}])
    assert [r["tower_id"] for r in entity.entity_summary(df).collect()] == ["AAA-1"]


def test_summary_does_not_depend_on_partitions(spark, folder):
    df = observations(spark, folder)
    one = entity.entity_summary(df.coalesce(1))
    many = entity.entity_summary(df.repartition(7, "row_id"))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_repeat_needs_two_impactful_rows(make_obs):
    df = make_obs([{"avg_users_affected": u} for u in (5, 0, 0)])
    assert entity.entity_summary(df).first()["repeat_outage_indicator"] == 0
    df = make_obs([{"avg_users_affected": u} for u in (5, 1, 0)])
    assert entity.entity_summary(df).first()["repeat_outage_indicator"] == 1


def test_published_thresholds_and_categories(make_obs):
    rows = []
    # Four towers meeting 0, 1, 2 and 4 conditions.
    rows.append({"tower_id": "AAA-0"})
    rows.append({"tower_id": "AAA-1", "uptime_percentage": Decimal("89.43")})
    rows.append({"tower_id": "AAA-2", "uptime_percentage": Decimal("85.00"), "avg_users_affected": 411})
    for _ in range(2):
        rows.append({
            "tower_id": "AAA-4", "uptime_percentage": Decimal("86.00"),
            "downtime_minutes": Decimal("201.00"), "avg_users_affected": 400,
        })
    summary = entity.entity_summary(make_obs(rows))
    got = {
        r["tower_id"]: (r["risk_points"], r["site_risk_category_preliminary"])
        for r in risk.add_risk(summary, risk.PUBLISHED_THRESHOLDS).collect()
    }
    assert got == {
        "AAA-0": (0, "Low Risk"), "AAA-1": (1, "Medium Risk"), "AAA-2": (2, "High Risk"),
        "AAA-4": (4, "Critical Risk"),
    }


def test_attached_risk_keeps_unmatched_rows(make_obs):
    df = make_obs([{"tower_id": "AAA-1"}, {"tower_id": None}])
    scored = risk.add_risk(entity.entity_summary(df), risk.PUBLISHED_THRESHOLDS)
    rows = risk.attach_risk(df, scored).collect()
    assert len(rows) == 2
    assert {r["tower_id"]: r["repeat_outage_indicator"] for r in rows} == {"AAA-1": 0, None: None}


def test_score_bounds_and_inverted_uptime(spark, folder):
    rates = score.entity_rates(observations(spark, folder))
    scored = score.add_score(score.add_components(rates))
    row = scored.agg(
        F.min("site_reliability_risk_score").alias("lo"),
        F.max("site_reliability_risk_score").alias("hi"),
        F.max_by("norm_uptime_risk", -F.col("avg_uptime_percentage")).alias("worst"),
    ).first()
    assert 0 <= row["lo"] <= row["hi"] <= 100
    assert row["worst"] == 1.0


def test_component_without_spread_is_null(make_obs):
    rates = score.entity_rates(make_obs([{"tower_id": "AAA-1"}, {"tower_id": "AAA-2"}]))
    assert score.add_components(rates).first()["norm_impact_risk"] is None


def test_weights_are_parameters(spark, folder):
    components = score.add_components(score.entity_rates(observations(spark, folder)))
    scored = score.add_score(components, {"norm_impact_risk": 1.0})
    wrong = scored.where(
        F.abs(F.col("site_reliability_risk_score") - 100 * F.col("norm_impact_risk")) > 1e-9
    )
    assert wrong.count() == 0


def test_duplicate_rows_and_keys(spark):
    rows = [("a", "x", 1), ("a", "x", 1), ("a", "x", 2), (None, "y", 3), (None, "y", 3), ("b", "z", 4)]
    df = spark.createDataFrame(rows, "k string, d string, v int").repartition(4)
    assert quality.duplicate_row_groups(df, ["k", "d", "v"]).first()[0] == 2
    got = [tuple(r) for r in quality.duplicate_keys(df, ["k", "d"], {"values": "v"}).collect()]
    assert got == [("a", "x", 3, 2), (None, "y", 2, 1)]


def test_duplicates_with_one_dominant_row(spark):
    # A third of all rows are copies of one row.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v")
    )
    assert quality.duplicate_row_groups(df, ["v"]).first()[0] == 1


def test_casefold_check_counts(spark, folder):
    got = {
        r["col"]: (r["raw_distinct"], r["lower_distinct"])
        for r in quality.casefold_check(raw_observations(spark, folder), ["operator", "state"]).collect()
    }
    assert got["operator"][0] > got["operator"][1]
    assert got["state"][0] == got["state"][1]


@pytest.mark.parametrize("n,limit", [(5, 2)])
def test_duplicate_key_limit(spark, n, limit):
    df = spark.range(2 * n).select((F.col("id") % n).cast("string").alias("k"), F.col("id").alias("v"))
    got = quality.duplicate_keys(df, ["k"], {"values": "v"}, limit).collect()
    assert [r["k"] for r in got] == ["0", "1"]


def test_headline_check_fails_on_a_damaged_layer(make_obs):
    whole = make_obs([{"outage_count": 2}, {}, {}])
    expected = whole.agg(
        F.round(F.avg("uptime_percentage"), 2).alias("avg_uptime_pct"),
        F.sum("downtime_minutes").alias("total_downtime"),
        F.sum("outage_count").alias("total_outages"),
        F.sum("avg_users_affected").alias("total_users_affected"),
    )
    names = [f"{c}_ok" for c in expected.columns]
    assert all(rollup.headline_check(whole, expected).first()[n] for n in names)
    damaged = whole.withColumn("outage_count", F.when(F.col("row_id") == 1, 3).otherwise(F.col("outage_count")))
    row = rollup.headline_check(damaged, expected).first()
    assert not row["total_outages_ok"] and row["total_downtime_ok"]
    assert not rollup.headline_check(whole.where("row_id > 1"), expected).first()["total_downtime_ok"]


def test_rows_without_entity_change_no_score(make_obs):
    known = [
        {"tower_id": f"AAA-{i % 4}", "row_id": i, "uptime_percentage": Decimal(90 + i), "avg_users_affected": i}
        for i in range(8)
    ]
    odd = [{"tower_id": None, "row_id": 50, "uptime_percentage": Decimal("1.00"), "avg_users_affected": 99999}]
    tables = [
        {r["tower_id"]: tuple(r) for r in stages.score_table(make_obs(rows)).collect()}
        for rows in (known, known + odd)
    ]
    assert tables[0] == tables[1] and None not in tables[1]


def test_scores_out_of_the_full_history_are_the_same(make_obs):
    rows = make_obs([
        {"tower_id": f"AAA-{i % 3}", "row_id": i, "downtime_minutes": Decimal(i), "avg_users_affected": i % 4}
        for i in range(12)
    ])
    full = frozen(history.full_history(rows))
    a, b = stages.score_table(rows), stages.scores_of(full)
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())


def test_another_entity_name_from_rows_to_the_list(make_obs):
    roles = Roles(entity="site")
    rows = make_obs([
        {"tower_id": f"AAA-{i % 5}", "row_id": i, "downtime_minutes": Decimal(i), "avg_users_affected": i % 4,
         "operator": f"o{i % 2}"}
        for i in range(20)
    ]).withColumnRenamed("tower_id", "site")
    full = frozen(history.full_history(rows, roles))
    scored = full.withColumn(watchlist.PROBABILITY, F.col("hist_pct_impactful"))
    merged = watchlist.merge(watchlist.add_band(scored), stages.scores_of(full, roles), roles)
    listed = watchlist.output(watchlist.add_priority(merged, entity="site"), roles)
    assert listed.columns == list(watchlist.OUTPUT) and listed.count() == 5
    check = watchlist.validate(listed, rows, roles).first()
    assert check["covers_all"] and check["key_unique"]
    board = stages.risk_table(rows, roles=roles)
    legends = dashboard.materialised_legends(rows, roles)
    assert dashboard.crosstab(listed, board, legends, roles).agg(F.sum("n")).first()[0] == 5
    assert history.history_features(rows, roles).count() == 15
