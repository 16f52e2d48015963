from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewatch.operators import evaluate, quantiles
from sitewatch.operators.ordering import global_position, running_totals
from sitewatch.operators.quantiles import exact_quantiles


@pytest.fixture
def numbers(spark):
    # A third of the rows share one value.
    return spark.range(3001).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.col("id") * 7919 % 1000 / 1000).alias("x"),
    ).repartition(5)


def test_global_position(numbers, many_partitions):
    got = global_position(numbers, [F.desc("x"), F.asc("id")], "place").collect()
    wanted = sorted(got, key=lambda r: (-r["x"], r["id"]))
    assert [r["place"] for r in wanted] == list(range(1, 3002))


def test_running_totals(numbers, many_partitions):
    got = running_totals(numbers.withColumn("w", F.col("id") % 5), [F.asc("x"), F.asc("id")], ["w"])
    before = 0
    for r in sorted(got.collect(), key=lambda r: (r["x"], r["id"])):
        assert r["w_before"] == before
        before += r["w"]


def test_quantiles_match_linear_interpolation(numbers, many_partitions):
    probs = [0.0, 0.25, 0.5, 0.753, 1.0]
    row = exact_quantiles(numbers, ["x", "id"], probs).first()
    rows = numbers.collect()
    for c in ("x", "id"):
        wanted = np.quantile([r[c] for r in rows], probs)
        assert row[c] == pytest.approx(list(wanted), abs=1e-12)


def test_quantiles_gather_no_values_in_one_task(numbers):
    plan = exact_quantiles(numbers, ["x", "id"], [0.5])._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "percentile" not in plan


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_whatever_the_sketch(spark, monkeypatch, accuracy):
    """Coarse sketches cost rounds; ties, one value, both zeros and infinities are counted out."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(accuracy)
    columns = {
        "random": rng.normal(size=1501),
        "hot": np.where(rng.random(1501) < 0.4, 7.0, rng.integers(0, 20, 1501)),
        "one": np.full(1501, -2.5),
        "ends": np.where(rng.random(1501) < 0.3, np.inf, np.where(rng.random(1501) < 0.5, -0.0, 0.0)),
    }
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in columns.values()])), list(columns)).repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.7531, 0.99, 1.0]
    row = exact_quantiles(df, list(columns), probs).first()
    for name, values in columns.items():
        low, high = (np.quantile(values, probs, method=m) for m in ("lower", "higher"))
        same = low == high
        assert np.array(row[name])[same].tolist() == low[same].tolist()
        rest = np.quantile(values[np.isfinite(values)], probs) if name == "ends" else np.quantile(values, probs)
        assert np.array(row[name])[~same] == pytest.approx(rest[~same], abs=1e-12)


def test_values_at_ranks_are_those_of_the_sorted_column(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 8)
    values = [float(x * x % 97) for x in range(400)] + [float("nan")] * 3
    typed = spark.createDataFrame([(v,) for v in values] + [(None,)] * 9, "x double").repartition(5)
    ranks = [0, 1, 57, 199, 200, 398, 399, 400, 402]
    got = quantiles.values_at(typed, {"x": len(values)}, {"x": ranks})["x"]
    assert sorted(got) == ranks
    assert [got[k] for k in ranks[:7]] == [sorted(values[:400])[k] for k in ranks[:7]]
    assert np.isnan([got[400], got[402]]).all()


def test_quantiles_of_columns_without_values(spark):
    df = spark.createDataFrame([(None, 3.0)], "x double, y double")
    row = exact_quantiles(df, ["x", "y"], [0.1, 0.5]).first()
    assert row["x"] is None and row["y"] == [3.0, 3.0]
    assert exact_quantiles(df.limit(0), ["x", "y"], [0.5]).first()["y"] is None


def test_quantiles_skip_nulls(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).first()["x"] == [1.5]


def test_auc_of_reversed_scores(spark, many_partitions):
    df = spark.range(2000).select(
        (F.col("id") * 37 % 101 / 100).alias("p"), (F.col("id") * 13 % 7 < 3).cast("int").alias("label")
    )
    auc = evaluate.roc_auc(df).first()[0]
    reverse = evaluate.roc_auc(df.withColumn("p", -F.col("p"))).first()[0]
    assert auc + reverse == pytest.approx(1, abs=1e-12)
    rows = df.collect()
    pos = [r["p"] for r in rows if r["label"] == 1]
    neg = [r["p"] for r in rows if r["label"] == 0]
    wins = sum((np.array(neg) < p).sum() + 0.5 * (np.array(neg) == p).sum() for p in pos)
    assert auc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


def test_auc_with_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "p double, label int")
    assert evaluate.roc_auc(df).first()[0] is None


def test_metrics_without_positive_predictions(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0)], "p double, label int")
    row = evaluate.threshold_metrics(df).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.5, 0.0, 0.0, 0.0)


def test_roc_ends_at_one(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "p double, label int")
    points = sorted((r["fpr"], r["tpr"]) for r in evaluate.roc_points(df).collect())
    assert points == [(0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]
