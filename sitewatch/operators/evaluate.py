"""Classifier evaluation on scored rows (label 0/1 and a probability)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatch.operators.ordering import running_totals


def threshold_metrics(
    scored: DataFrame, label: str = "label", probability: str = "p", cut: float = 0.5
) -> DataFrame:
    """Accuracy, precision, recall and F1 of predicting 1 above ``cut``; 0 when undefined."""
    positive = F.col(label) == 1
    predicted = F.col(probability) > cut
    counts = scored.agg(
        F.count_if(positive & predicted).alias("tp"),
        F.count_if(~positive & predicted).alias("fp"),
        F.count_if(positive & ~predicted).alias("fn"),
        F.count_if(~positive & ~predicted).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return counts.select(
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion(
    scored: DataFrame, label: str = "label", probability: str = "p", cut: float = 0.5
) -> DataFrame:
    """All four cells of the confusion matrix, empty ones with 0."""
    predicted = F.col(probability) > cut
    cells = scored.agg(
        *[
            F.count_if((F.col(label) == a) & (predicted if p else ~predicted)).alias(f"c{a}{p}")
            for a in (0, 1)
            for p in (0, 1)
        ]
    )
    entries = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("n"))
        for a in (0, 1)
        for p in (0, 1)
    ]
    return cells.select(F.inline(F.array(*entries)))


def _by_score(scored: DataFrame, label: str, probability: str) -> DataFrame:
    """Positives and negatives per distinct score: ties are one row from here on."""
    return scored.groupBy(F.col(probability).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def roc_auc(scored: DataFrame, label: str = "label", probability: str = "p") -> DataFrame:
    """Exact area under the ROC curve; NULL when only one class occurs.

    Each positive is ranked against the negatives with lower scores, ties counting half.
    """
    ranked = running_totals(
        _by_score(scored, label, probability), [F.col("score").asc()], ["neg"]
    )
    half = "decimal(30,1)"
    won = F.col("pos").cast(half) * (
        F.col("neg_before").cast("decimal(20,1)") + F.col("neg").cast("decimal(20,1)") / 2
    ).cast("decimal(21,1)")
    return ranked.agg(
        F.try_divide(
            F.sum(won).cast("double"), F.sum("pos").cast("double") * F.sum("neg").cast("double")
        ).alias("roc_auc")
    )


def roc_points(scored: DataFrame, label: str = "label", probability: str = "p") -> DataFrame:
    """False- and true-positive rate at every distinct score, highest score first."""
    ranked = running_totals(
        _by_score(scored, label, probability), [F.col("score").desc()], ["pos", "neg"]
    )
    totals = ranked.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return ranked.crossJoin(F.broadcast(totals)).select(
        F.col("score").alias("threshold"),
        F.try_divide((F.col("neg_before") + F.col("neg")).cast("double"), "all_neg").alias("fpr"),
        F.try_divide((F.col("pos_before") + F.col("pos")).cast("double"), "all_pos").alias("tpr"),
    )
