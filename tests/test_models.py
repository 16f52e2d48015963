from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import check
from oracles import ORACLES
from sitewatch.operators import evaluate, history, model, nodes
from sitewatch.plans import stages
from sitewatch.plans.catalog import CATALOG
from sitewatch.sources import scratch
from sitewatch.sources.observations import observations

CONFIG = model.ModelConfig(trees=10, tree_depth=4, tree_min_rows=5, stages=4)


@pytest.fixture(scope="module")
def sides(spark):
    return stages.train_and_test(observations(spark, "/root/testdata/sf0.01"))


@pytest.fixture(scope="module")
def logistic(sides):
    return model.fit_logistic(sides[0])


def test_split_is_by_time(sides):
    train, test = sides
    last = train.agg(F.max("target_date")).first()[0]
    first = test.agg(F.min("target_date")).first()[0]
    assert last < first


def test_balanced_weights(sides):
    rows = model.class_weights(sides[0]).collect()
    totals = [r["n"] * r["weight"] for r in rows]
    assert totals == pytest.approx([sum(r["n"] for r in rows) / 2] * 2)


def test_encoder_gives_zeros_for_unseen_and_unknown(spark, sides):
    train = sides[0].limit(200)
    odd = sides[0].limit(1).withColumn("hist_mode_operator", F.lit("new")).withColumn(
        "hist_city", F.lit(None).cast("string"))
    row = Pipeline(stages=model.encoder()).fit(train).transform(odd).first()
    assert row["hist_mode_operator_onehot"].numNonzeros() == 0
    assert row["hist_city_onehot"].numNonzeros() == 0
    assert row["hist_mode_state_onehot"].numNonzeros() == 1


def test_logistic_optimum(sides, logistic):
    """The gradient of 1/2 |w|^2 + sum of weighted losses vanishes at the fitted weights."""
    train = sides[0]
    weighted = model.add_class_weight(train)
    rows = logistic.transform(weighted).select("features", model.LABEL, model.WEIGHT).collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([r[model.LABEL] for r in rows], dtype=float)
    s = np.array([r[model.WEIGHT] for r in rows])
    fitted = logistic.stages[-1]
    w, b = fitted.coefficients.toArray(), fitted.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    n = len(rows)
    assert np.abs(w + x.T @ (s * (p - y))).max() / n < 1e-5
    assert abs((s * (p - y)).sum()) / n < 1e-5


def test_scaled_features_use_training_statistics(sides, logistic):
    scaled = logistic.transform(sides[0])
    row = scaled.agg(
        F.avg("z_hist_avg_uptime").alias("m"), F.stddev_pop("z_hist_avg_uptime").alias("s")
    ).first()
    assert row["m"] == pytest.approx(0, abs=1e-9)
    assert row["s"] == pytest.approx(1, abs=1e-9)


def test_saved_model_predicts_the_same(spark, sides, logistic):
    path = scratch.scratch_path(spark, "model")
    model.save(logistic, path)
    a = model.predict(logistic, sides[1]).select("row_id", "p")
    b = model.predict(model.load(path), sides[1]).select("row_id", "p")
    assert a.exceptAll(b).count() == 0


def test_tree_models_and_importance(sides):
    train, test = sides
    forest = model.fit_forest(train, CONFIG)
    top = model.importance(forest, train, 5).collect()
    assert len(top) == 5
    assert [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True)
    names = model.feature_names(forest, train)
    assert names[0] == "hist_num_observations"
    assert any(n.startswith("hist_mode_operator_onehot_") for n in names)
    boosted = model.fit_boosting(train, CONFIG)
    for fitted, name in ((forest, "forest"), (boosted, "boosting")):
        row = model.evaluate(fitted, test, name).first()
        assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == test.count()
        assert 0 <= row["roc_auc"] <= 1


def test_the_importance_query_returns_every_feature(spark):
    """All of them with a place, not the first ten; those are the reference's list."""
    folder = "/root/testdata/sf0.001"
    got = {r["feature"]: r for r in CATALOG["ml_importance"](spark, folder).collect()}
    train, _ = stages.train_and_test(observations(spark, folder))
    seen = train.select(*model.DEFAULTS.labels).collect()
    hot = {f"{c}_onehot_{r[c]}" for r in seen for c in model.DEFAULTS.labels if r[c] is not None}
    assert set(got) == set(model.DEFAULTS.numeric) | hot and len(got) > 10
    ranked = sorted(got.values(), key=lambda r: r["place"])
    assert [r["place"] for r in ranked] == list(range(1, len(got) + 1))
    assert [r["importance"] for r in ranked] == sorted((r["importance"] for r in ranked), reverse=True)
    assert sum(r["importance"] for r in ranked) == pytest.approx(1, abs=5e-5 * len(got))


def test_the_importance_query_has_all_that_its_former_sql_had(spark):
    """Its SQL went to ml_importance_facts; rows and columns of that are in the query beside the values."""
    folder = "/root/testdata/sf0.001"
    got = CATALOG["ml_importance"](spark, folder)
    assert {"importance", "place"} < set(got.columns)
    facts = got.select("feature", "not_negative", "total")
    ok, note = check.compare(facts, check.oracle_connection(folder), ORACLES["ml_importance_facts"])
    assert ok, note


def test_predictions_cover_every_tower(spark, folder, logistic):
    rows = observations(spark, folder)
    predicted = stages.predictions(logistic, history.full_history(rows))
    assert predicted.count() == rows.select("tower_id").distinct().count()
    assert predicted.where("predicted_risk_probability IS NULL").count() == 0


def test_gradient_tells_a_fit_from_none(sides, logistic):
    train, _ = sides
    row = model.gradient_norm(logistic, train).first()
    assert row["rows"] == train.count() and row["gradient"] < 1e-5
    stopped = model.fit_logistic(train, model.ModelConfig(iterations=1))
    assert model.gradient_norm(stopped, train).first()["gradient"] > 1e-4
    constant = model.fit_logistic(train, model.ModelConfig(iterations=0))
    assert model.gradient_norm(constant, train).first()["gradient"] > 1e-3


def plain_score(table, x, boosted):
    """The probability of one feature vector, down the exported nodes in plain Python."""
    total = weights = 0.0
    for tree in {t for t, _ in table}:
        node = table[tree, 0]
        while node["left"] is not None:
            value = x[node["position"]]
            left = value in node["values"] if node["values"] is not None else value <= node["threshold"]
            node = table[tree, node["left"] if left else node["right"]]
        total += node["weight"] * node["value"]
        weights += node["weight"]
    return 1 / (1 + np.exp(-2 * total)) if boosted else total / weights


@pytest.mark.parametrize("boosted", [False, True])
def test_exported_nodes_score_like_the_model(sides, boosted, monkeypatch):
    train, test = sides
    fitted = (model.fit_boosting if boosted else model.fit_forest)(train, CONFIG)
    table = scratch.frozen(nodes.tree_nodes(fitted, "m", train))
    assert table.where("threshold IS NOT NULL").count() and table.where("values IS NOT NULL").count()
    assert table.where("left IS NULL AND feature IS NOT NULL").count() == 0
    by_place = {(r["tree"], r["node"]): r for r in table.collect()}
    coded = fitted.transform(test)
    depth = CONFIG.stage_depth if boosted else CONFIG.tree_depth
    joined = dict(nodes.score_nodes(table, coded, "row_id", "features", depth, boosted).collect())
    monkeypatch.setattr(nodes, "SENT_ROWS", 0)
    shuffled = dict(nodes.score_nodes(table, coded, "row_id", "features", depth, boosted).collect())
    found = coded.select("row_id", "features", "probability").collect()
    assert len(joined) == len(shuffled) == len(found)
    for r in found:
        p = r["probability"][1]
        assert joined[r["row_id"]] == pytest.approx(p, abs=1e-9)
        assert shuffled[r["row_id"]] == pytest.approx(p, abs=1e-9)
        assert plain_score(by_place, r["features"].toArray(), boosted) == pytest.approx(p, abs=1e-9)


def test_models_beat_a_constant_where_there_is_signal(sides):
    """Labels that follow one feature: every model's area is far above a constant's half."""
    train, test = (
        s.withColumn(model.LABEL, (F.col("hist_avg_uptime") < 96).cast(s.schema[model.LABEL].dataType)) for s in sides
    )
    train, test = scratch.frozen(train), scratch.frozen(test)
    for fit in model.FITTERS.values():
        scored = model.predict(fit(train, CONFIG), test).select(F.col(model.LABEL).alias("label"), "p")
        assert evaluate.roc_auc(scored).first()[0] > 0.9


def test_rows_go_down_sent_trees_in_one_pass(sides, monkeypatch):
    """A row stays one row, however many trees and levels; with null and repeated keys, too few levels, and no trees."""
    train, test = sides
    fitted = model.fit_forest(train, CONFIG)
    table = scratch.frozen(nodes.tree_nodes(fitted, "m", train))
    coded = fitted.transform(test)
    key = F.when(F.col("row_id") % 7 != 0, F.col("row_id") % 50).alias("key")
    odd = coded.select(key, "features")

    def scores(nodes_table, depth):
        return dict(nodes.score_nodes(nodes_table, odd, "key", "features", depth, False).collect())

    for depth in (0, 2, CONFIG.tree_depth):
        with monkeypatch.context() as patch:
            sent = scores(table, depth)
            patch.setattr(nodes, "SENT_ROWS", 0)
            joined = scores(table, depth)
        assert None in sent and sent.keys() == joined.keys()
        assert all(sent[k] == pytest.approx(p, abs=1e-9) for k, p in joined.items())
    assert scores(table.limit(0), 2) == {}
    plan = nodes.score_nodes(table, odd, "key", "features", 8, False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan


def test_sets_of_categories_and_gaps_between_node_numbers(spark, monkeypatch):
    """Categories of any number go left together; nodes need not be numbered without gaps."""
    none = None
    table = spark.createDataFrame(
        [
            ("m", 0, 0, 0, "c", none, [0.0, 3.0], 4, 9, 0.5, 1.0), ("m", 0, 4, 1, "x", 2.0, none, 5, 7, 0.5, 1.0),
            ("m", 0, 5, none, none, none, none, none, none, 0.1, 1.0),
            ("m", 0, 7, none, none, none, none, none, none, 0.2, 1.0),
            ("m", 0, 9, none, none, none, none, none, none, 0.4, 1.0),
            ("m", 3, 0, none, none, none, none, none, none, 0.8, 3.0),
        ],
        "model string, tree int, node int, position int, feature string, threshold double, values array<double>, "
        "left int, right int, value double, weight double",
    )
    x = [(c, v) for c in (0.0, 1.0, 3.0) for v in (2.0, 2.5, float("nan"))]
    rows = spark.createDataFrame([(i, Vectors.dense(*v)) for i, v in enumerate(x)], ["i", "f"])
    leaf = [0.4 if c == 1 else 0.1 if v <= 2 else 0.2 for c, v in x]
    for sent in (1 << 20, 0):
        monkeypatch.setattr(nodes, "SENT_ROWS", sent)
        got = dict(nodes.score_nodes(table, rows, "i", "f", 2, False).collect())
        assert got == {i: pytest.approx((p + 2.4) / 4) for i, p in enumerate(leaf)}


def test_the_forest_keeps_the_nodes_of_rows(sides):
    """No row goes down from the roots at every level; the trees are the same as when it does."""
    train, test = sides
    fitted = model.fit_forest(train, CONFIG)
    last = fitted.stages[-1]
    assert last.getCacheNodeIds()
    weighted = model._with_weights(train)[0]
    again = RandomForestClassifier(
        **model._COLUMNS, weightCol=model.WEIGHT, numTrees=CONFIG.trees, maxDepth=CONFIG.tree_depth,
        minInstancesPerNode=CONFIG.tree_min_rows, featureSubsetStrategy="sqrt", seed=CONFIG.seed,
    ).fit(PipelineModel(fitted.stages[:-1]).transform(weighted))
    assert last.toDebugString.split("\n")[1:] == again.toDebugString.split("\n")[1:]
