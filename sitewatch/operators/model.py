"""Risk classifiers on history examples.

Pass a materialised training table: every estimator reads it several times.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.operators.evaluate import confusion, roc_auc, threshold_metrics
from sitewatch.operators.history import NUMERIC_FEATURES, label_features
from sitewatch.sources.scratch import checkpoint_root, frozen

LABEL = "next_period_high_risk"
WEIGHT = "class_weight"
PROBABILITY = "p"


@dataclass(frozen=True)
class ModelConfig:
    """Features and fixed hyper-parameters of the three classifiers."""

    numeric: tuple[str, ...] = NUMERIC_FEATURES
    labels: tuple[str, ...] = label_features()
    iterations: int = 1000
    tolerance: float = 1e-8
    trees: int = 300
    tree_depth: int = 8
    tree_min_rows: int = 20
    stages: int = 200
    stage_depth: int = 3
    stage_rate: float = 0.05
    seed: int = 42


DEFAULTS = ModelConfig()


def class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weights: every class gets the same total weight. One row per class."""
    counts = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    return counts.crossJoin(F.broadcast(totals)).select(
        "label", "n",
        F.try_divide(F.col("_all").cast("double"), F.col("_classes") * F.col("n")).alias("weight"),
    )


def add_class_weight(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weight on every training row; there is one broadcast row per class."""
    weights = class_weights(train, label).select(
        F.col("label").alias(label), F.col("weight").alias(WEIGHT)
    )
    return train.join(F.broadcast(weights), label)


def _with_weights(train: DataFrame, label: str = LABEL) -> tuple[DataFrame, int]:
    """Balanced weights written into the query, from one pass over the labels, and the row count.

    One row per class reaches the driver.
    """
    classes = class_weights(train, label).collect()
    weight = F.lit(None).cast("double")
    for r in classes:
        weight = F.when(F.col(label) == r["label"], F.lit(r["weight"])).otherwise(weight)
    return train.withColumn(WEIGHT, weight), sum(r["n"] for r in classes)


def scaling(train: DataFrame, columns: tuple[str, ...] = NUMERIC_FEATURES) -> DataFrame:
    """Mean and population standard deviation per numeric feature."""
    one_row = train.agg(
        *[
            F.struct(
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.stddev_pop(F.col(c).cast("double")).alias("std"),
            ).alias(c)
            for c in columns
        ]
    )
    return one_row.unpivot([], list(columns), "feature", "s").select("feature", "s.mean", "s.std")


def _scaler(train: DataFrame, columns: tuple[str, ...]) -> SQLTransformer:
    """Z-scores with the training statistics written into the stage (a few numbers)."""
    terms = []
    for r in scaling(train, columns).collect():
        # A feature that does not vary is only centred.
        std = r["std"] or 1.0
        terms.append(f"(CAST({r['feature']} AS DOUBLE) - ({r['mean']!r}D)) / {std!r}D AS z_{r['feature']}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def encoder(config: ModelConfig = DEFAULTS) -> list:
    """One column per label value seen in training; unseen and unknown values give zeros."""
    indexed = [f"{c}_index" for c in config.labels]
    return [
        StringIndexer(
            inputCols=list(config.labels), outputCols=indexed,
            handleInvalid="keep", stringOrderType="alphabetAsc",
        ),
        # The extra index for unseen values is the last one, which the encoder drops.
        OneHotEncoder(
            inputCols=indexed, outputCols=[f"{c}_onehot" for c in config.labels], dropLast=True
        ),
    ]


def assembler(config: ModelConfig = DEFAULTS, scaled: bool = False) -> VectorAssembler:
    numeric = [f"z_{c}" if scaled else c for c in config.numeric]
    return VectorAssembler(
        inputCols=[*numeric, *[f"{c}_onehot" for c in config.labels]], outputCol="features"
    )


_COLUMNS = {"featuresCol": "features", "labelCol": LABEL}


def fit_logistic(train: DataFrame, config: ModelConfig = DEFAULTS) -> PipelineModel:
    """L2-regularised logistic regression with unit inverse strength on z-scores.

    Balanced weights add up to the row count, so dividing the penalised objective by it gives
    a regularisation of one over the number of rows.
    """
    weighted, rows = _with_weights(train)
    model = LogisticRegression(
        **_COLUMNS, weightCol=WEIGHT, regParam=1.0 / rows,
        elasticNetParam=0.0, standardization=False, maxIter=config.iterations,
        tol=config.tolerance,
    )
    stages = [*encoder(config), _scaler(train, config.numeric), assembler(config, True), model]
    return Pipeline(stages=stages).fit(weighted)


def fit_forest(train: DataFrame, config: ModelConfig = DEFAULTS) -> PipelineModel:
    """Random forest with balanced weights.

    Rows keep their node in every tree from level to level, so none goes down all trees from the
    roots again: a number for each row and tree, in memory or on disk.
    """
    model = RandomForestClassifier(
        **_COLUMNS, weightCol=WEIGHT, numTrees=config.trees,
        maxDepth=config.tree_depth, minInstancesPerNode=config.tree_min_rows,
        featureSubsetStrategy="sqrt", seed=config.seed, cacheNodeIds=True,
    )
    return Pipeline(stages=[*encoder(config), assembler(config), model]).fit(_with_weights(train)[0])


def fit_boosting(train: DataFrame, config: ModelConfig = DEFAULTS) -> PipelineModel:
    """Gradient-boosted trees without weights; stages are checkpointed to cut their lineage."""
    checkpoint_root(train.sparkSession)
    model = GBTClassifier(
        **_COLUMNS, maxIter=config.stages, maxDepth=config.stage_depth,
        stepSize=config.stage_rate, checkpointInterval=10, seed=config.seed,
    )
    return Pipeline(stages=[*encoder(config), assembler(config), model]).fit(train)


FITTERS = {
    "Logistic Regression": fit_logistic,
    "Random Forest": fit_forest,
    "Gradient Boosting": fit_boosting,
}


def fit_models(train: DataFrame, config: ModelConfig = DEFAULTS) -> dict[str, PipelineModel]:
    return {name: fit(train, config) for name, fit in FITTERS.items()}


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the probability of the positive class as ``p``."""
    scored = model.transform(rows)
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias(PROBABILITY))


def evaluate(model: PipelineModel, test: DataFrame, name: str, scored: DataFrame | None = None) -> DataFrame:
    """One row: the threshold metrics, the area under the ROC curve, the confusion matrix.

    ``scored`` are the written predictions of all rows of ``test``, if there are any yet.
    """
    # Scored once; the model is not applied again for every figure.
    if scored is None:
        scored = frozen(predict(model, test).select(LABEL, PROBABILITY))
    scored = scored.select(F.col(LABEL).alias("label"), PROBABILITY)
    cells = confusion(scored).agg(
        *[
            F.max(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))).alias(n)
            for n, a, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
        ]
    )
    return (
        threshold_metrics(scored)
        .crossJoin(F.broadcast(roc_auc(scored)))
        .crossJoin(F.broadcast(cells))
        .select(F.lit(name).alias("model"), "*")
    )


def gradient_norm(model: PipelineModel, train: DataFrame) -> DataFrame:
    """One row ``(rows, gradient)``: how far a fitted logistic regression is from its optimum.

    ``gradient`` is the largest absolute entry of the gradient of the penalised objective, a row's
    share of it, at the fitted weights; zero only at the optimum. One aggregate: rows are
    turned to one partial sum a feature before the shuffle.
    """
    weighted, _ = _with_weights(train)
    fitted = model.stages[-1]
    # The intercept is the weight of a last feature that is always one, and has no penalty.
    penalty = F.lit([*fitted.coefficients.toArray().tolist(), 0.0])
    off = F.col(WEIGHT) * (vector_to_array("probability")[1] - F.col(LABEL))
    entries = model.transform(weighted).select(
        off.alias("off"), F.posexplode(F.array_append(vector_to_array("features"), F.lit(1.0))).alias("i", "x")
    )
    sums = entries.groupBy("i").agg(F.sum(F.col("off") * F.col("x")).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.agg(
        F.max("n").alias("rows"), F.max(F.abs(F.col("s") + F.get(penalty, F.col("i"))) / F.col("n")).alias("gradient")
    )


def feature_names(model: PipelineModel, rows: DataFrame) -> list[str]:
    """Names behind the positions of the feature vector, from the column's metadata."""
    metadata = model.transform(rows.limit(0)).schema["features"].metadata["ml_attr"]
    attributes = [a for group in metadata["attrs"].values() for a in group]
    return [a["name"] for a in sorted(attributes, key=lambda a: a["idx"])]


def importances(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The importance of every feature of a tree model."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    names = feature_names(model, rows)
    return rows.sparkSession.createDataFrame(
        list(zip(names, weights)), "feature string, importance double"
    )


def importance(model: PipelineModel, rows: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most important features of a tree model, rounded to four decimals."""
    return (
        importances(model, rows)
        .orderBy(F.desc("importance"), "feature")
        .limit(n)
        .select("feature", F.round("importance", 4).alias("importance"))
    )


def ranked_importances(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Every feature of a tree model with its importance, rounded, and its place from 1.

    Places follow the importances before rounding, then the names. Beside them is what must hold of
    any fit: whether an importance is ``not_negative``, and the ``total`` of all, which is one.
    """
    # One row a feature: no more than the fitted model itself holds.
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return importances(model, rows).select(
        "feature", F.round("importance", 4).alias("importance"), place.alias("place"),
        (F.col("importance") >= 0).alias("not_negative"),
        F.round(F.sum("importance").over(everything), 6).alias("total"),
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def slug(name: str) -> str:
    return name.lower().replace(" ", "_")


def save_bundle(models: dict[str, PipelineModel], test: DataFrame, path: str) -> None:
    """All fitted models below ``path``, their metrics, and the test rows scored by each."""
    metrics, scored = [], []
    for name, fitted in models.items():
        save(fitted, f"{path}/models/{slug(name)}")
        metrics.append(evaluate(fitted, test, name))
        scored.append(predict(fitted, test).select(F.lit(name).alias("model"), *test.columns, PROBABILITY))
    reduce(DataFrame.unionByName, metrics).write.mode("overwrite").parquet(f"{path}/metrics")
    reduce(DataFrame.unionByName, scored).write.mode("overwrite").parquet(f"{path}/scored")


def load_bundle(
    spark: SparkSession, path: str, names: Iterable[str] = tuple(FITTERS)
) -> tuple[dict[str, PipelineModel], DataFrame, DataFrame]:
    """Models, metrics and scored test rows of a saved bundle."""
    models = {name: load(f"{path}/models/{slug(name)}") for name in names}
    return models, spark.read.parquet(f"{path}/metrics"), spark.read.parquet(f"{path}/scored")
