"""Tables the reports are built on, each a composition of operators.

A table that several later steps read is written once to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatch.operators import entity, history, model, risk, score, watchlist
from sitewatch.roles import TOWERS, Roles
from sitewatch.sources.scratch import frozen


def risk_table(
    rows: DataFrame, thresholds: dict[str, float] | None = None, roles: Roles = TOWERS
) -> DataFrame:
    """Entity summary with preliminary risk points and category."""
    summary = entity.entity_summary(rows, roles)
    # Own quartiles read the summary twice.
    return risk.add_risk(summary if thresholds else frozen(summary), thresholds)


def score_components(rows: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    return score.add_components(frozen(score.entity_rates(rows, roles)))


def score_table(rows: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Rate-based score and category of every entity."""
    return score.add_category(score.add_score(score_components(rows, roles)))


def scores_of(full_history: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """The scores out of a written full history, without aggregating the rows again."""
    return score.add_category(score.add_score(score.add_components(score.rates_of(full_history, roles))))


def examples(rows: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """History examples with the time split."""
    return history.time_split(frozen(history.history_features(rows, roles)))


def train_and_test(rows: DataFrame, roles: Roles = TOWERS) -> tuple[DataFrame, DataFrame]:
    """Examples before and from the split date; the date is a value, so reads are filtered."""
    table = frozen(history.history_features(rows, roles))
    cut = F.lit(history.split_date(table).first()["split_date"])
    return table.where(F.col("target_date") < cut), table.where(F.col("target_date") >= cut)


def predictions(fitted: PipelineModel, full_history: DataFrame) -> DataFrame:
    """Every entity's full history with its predicted probability and band."""
    scored = model.predict(fitted, full_history)
    return watchlist.add_band(
        scored.withColumnRenamed(model.PROBABILITY, watchlist.PROBABILITY)
    )


def watch_table(fitted: PipelineModel, rows: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """The ranked list of all entities; the rows are aggregated by entity once."""
    full = frozen(history.full_history(rows, roles))
    merged = watchlist.merge(predictions(fitted, full), scores_of(full, roles), roles)
    return watchlist.output(watchlist.add_priority(merged, entity=roles.entity), roles)
