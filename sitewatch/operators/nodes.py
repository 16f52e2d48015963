"""Fitted trees as tables of nodes, and scoring by joins with them.

A model leaves Spark ML as rows: every tree's nodes with their tests, children and values. What
reads tables can then score without Spark ML, and a model can be looked into with SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitewatch.operators.model import feature_names
from sitewatch.sources.scratch import scratch_path

# A node table of up to so many rows is sent to all tasks: some 60 bytes a row.
SENT_ROWS = 1 << 20


def tree_nodes(model: PipelineModel, name: str, rows: DataFrame) -> DataFrame:
    """``(model, tree, node, position, feature, threshold, values, left, right, value, weight)``.

    A row goes to ``left`` if its feature, at ``position`` from 0 on of the feature vector, is at
    most ``threshold``, or among ``values`` where the feature is a category; node 0 is the root.
    At a leaf the children are NULL. ``value`` is the share of the positive class that reached
    the node in a forest, and a boosted tree's output; ``weight`` is the tree's. ``rows`` gives the
    columns that the features are made of; it is not read.
    """
    last = model.stages[-1]
    spark = rows.sparkSession
    path = scratch_path(spark, "trees")
    last.write().save(path)
    forest = isinstance(last, RandomForestClassificationModel)
    if not forest and not isinstance(last, GBTClassificationModel):
        raise ValueError("neither a forest nor boosted trees")
    names = F.lit(feature_names(model, rows))
    node, split = F.col("nodeData"), F.col("nodeData.split")
    inner, category = node["leftChild"] >= 0, split["numCategories"] >= 0
    tests = split["leftCategoriesOrThreshold"]
    stats = node["impurityStats"]
    value = F.try_divide(stats[1], stats[0] + stats[1]) if forest else node["prediction"]
    weights = spark.read.parquet(f"{path}/treesMetadata").select(
        F.col("_1").alias("tree"), F.col("_3").alias("weight")
    )
    table = spark.read.parquet(f"{path}/data").select(
        F.lit(name).alias("model"),
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, split["featureIndex"]).alias("position"),
        F.when(inner, F.get(names, split["featureIndex"])).alias("feature"),
        F.when(inner & ~category, F.get(tests, F.lit(0))).alias("threshold"),
        F.when(inner & category, tests).alias("values"),
        F.when(inner, node["leftChild"]).alias("left"),
        F.when(inner, node["rightChild"]).alias("right"),
        value.alias("value"),
    )
    return table.join(F.broadcast(weights), "tree").select(  # one row per tree
        "model", "tree", "node", "position", "feature", "threshold", "values", "left", "right",
        "value", "weight",
    )


def score_nodes(nodes: DataFrame, rows: DataFrame, key: str, features: str, depth: int, boosted: bool) -> DataFrame:
    """``(key, p)``: the probability of the positive class by a node table of ``depth`` levels.

    ``features`` is the feature vector. Every row goes down all trees together, level by
    level; a forest's probability is the mean of its leaves, a boosted model's the logistic
    function of twice its weighted sum. The table is bounded by the model's size, whatever the
    data: it is sent to all tasks, which look up blocks of rows in it. Above ``SENT_ROWS`` nodes it is joined
    without being sent, one join a level.
    """
    size = nodes.agg(F.count(F.lit(1)), F.max("tree")).first()
    table = nodes.select("tree", "node", *_TESTS, "value", "weight")
    at = rows.select(F.col(key).alias("key"), vector_to_array(features).alias("x"))
    sums = _sums_by_lookup(table, at, depth) if size[0] <= SENT_ROWS else _sums_by_joins(table, at, depth, size[1])
    margin, weight = F.sum("s"), F.sum("w")
    p = 1 / (1 + F.exp(-2 * margin)) if boosted else margin / weight
    return sums.groupBy("key").agg(p.alias("p")).select(F.col("key").alias(key), "p")


_TESTS = ("position", "threshold", "values", "left", "right")


def _sums_by_joins(table: DataFrame, at: DataFrame, depth: int, last: int) -> DataFrame:
    """``(key, s, w)``: weighted value and weight of the leaf of every row in every tree."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(last)))
    at = at.select("key", "x", trees.alias("tree"), F.lit(0).alias("node"))
    for _ in range(depth):
        at = at.join(table, ["tree", "node"]).select("key", "x", "tree", _child().alias("node"))
    leaf = at.join(table, ["tree", "node"])
    return leaf.select("key", (F.col("weight") * F.col("value")).alias("s"), F.col("weight").alias("w"))


def _child() -> Column:
    """The node a row goes on to; at a leaf it stays."""
    x = F.get("x", F.col("position"))
    goes_left = F.when(F.col("values").isNotNull(), F.array_contains("values", x)).otherwise(x <= F.col("threshold"))
    return F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))


# Rows that go down a tree together.
_BLOCK = 4096


def _sums_by_lookup(table: DataFrame, at: DataFrame, depth: int) -> DataFrame:
    """The same, a row's trees added up, from arrays of the nodes in every task."""
    trees = _arrays(table.orderBy("tree", "node").toArrow())
    position, threshold, categories, left, right, weighted, roots, weight = trees

    def sums(x: np.ndarray) -> np.ndarray:
        total, flat, starts = np.zeros(len(x)), x.ravel(), np.arange(len(x)) * x.shape[1]
        for root in roots:
            at = np.full(len(x), root)
            for _ in range(depth):
                value = flat[starts + position[at]]
                goes_left = value <= threshold[at]
                for category in categories:
                    goes_left |= value == category[at]
                at = np.where(goes_left, left[at], right[at])
            total += weighted[at]
        return total

    # Nothing of this module is used by name in a task, so workers need not import it.
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(roots):
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = np.concatenate([sums(x[i : i + block]) for i in range(0, len(x), block)])
            columns = [batch.column("key"), pa.array(found), pa.array(np.full(len(x), weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "s", "w"])

    block = _BLOCK
    schema = StructType().add("key", at.schema["key"].dataType).add("s", "double").add("w", "double")
    return at.mapInArrow(score, schema)


def _arrays(table: pa.Table) -> tuple:
    """Nodes in order of (tree, node) as arrays, with places in them for children.

    Position, threshold, category values, left, right and weighted value of every node; the places of the
    roots and the sum of their weights. A leaf is its own child; where a node tests for categories,
    no number is at most its threshold.
    """

    def numbers(name: str, missing: float) -> np.ndarray:
        return pc.fill_null(table[name], missing).to_numpy()

    tree, node = numbers("tree", -1).astype(np.int64), numbers("node", -1).astype(np.int64)
    inner, roots = table["left"].is_valid().to_numpy(), np.flatnonzero(node == 0)
    values = table["values"].to_pylist()
    categories = np.full((max((len(v) for v in values if v), default=0), len(values)), np.nan)
    for i, found in enumerate(values):
        categories[: len(found or ()), i] = found or ()
    span = node.max(initial=0) + 1
    places = tree * span + node
    left, right = (
        np.where(inner, np.searchsorted(places, tree * span + numbers(c, 0)), np.arange(len(node)))
        for c in ("left", "right")
    )
    weight = numbers("weight", 0.0)
    weighted = weight * numbers("value", 0.0)
    position, threshold = numbers("position", 0), numbers("threshold", -np.inf)
    return position, threshold, categories, left, right, weighted, roots, weight[roots].sum()
