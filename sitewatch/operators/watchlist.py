"""The ranked list of all entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.functions.bands import PROBABILITY_LEVELS, PROBABILITY_LIMITS, at_most
from sitewatch.operators.ordering import global_position
from sitewatch.roles import TOWERS, Roles

PROBABILITY = "predicted_risk_probability"
SCORE = "site_reliability_risk_score"

# Columns of the watchlist, output name to source column, in order.
OUTPUT = {
    "tower_id": "tower_id",
    "operator": "hist_mode_operator",
    "state": "hist_mode_state",
    "city": "hist_city",
    "network_type": "hist_mode_network_type",
    "latest_uptime": "latest_uptime",
    "historical_total_downtime_minutes": "hist_total_downtime",
    "historical_total_outage_count": "hist_total_outage_count",
    "site_reliability_risk_score": "site_reliability_risk_score",
    "risk_category_final": "risk_category_final",
    "predicted_risk_probability": "predicted_risk_probability",
    "predicted_risk_category": "predicted_risk_category",
    "recommended_priority": "recommended_priority",
}


def probability_band(probability: Column) -> Column:
    """Low to Critical in quarters that include their upper limit; NULL stays NULL."""
    band = at_most(probability, PROBABILITY_LIMITS, PROBABILITY_LEVELS)
    return F.when(probability.isNotNull(), band)


def add_band(df: DataFrame, probability: str = PROBABILITY) -> DataFrame:
    return df.withColumn("predicted_risk_category", probability_band(F.col(probability)))


def merge(predictions: DataFrame, scored: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Predictions with the score of the same entity; both sides have one row per entity."""
    scores = scored.select(roles.entity, SCORE, "risk_category_final")
    return predictions.join(scores, roles.entity)


def add_priority(
    df: DataFrame,
    probability: str = PROBABILITY,
    score: str = SCORE,
    entity: str = TOWERS.entity,
) -> DataFrame:
    """1-based position by probability, then score, both descending, then entity."""
    order = [
        F.col(probability).desc_nulls_last(), F.col(score).desc_nulls_last(), F.col(entity).asc(),
    ]
    return global_position(df, order, "recommended_priority")


def output_columns(roles: Roles = TOWERS) -> dict[str, str]:
    """Output name to source column: the output names stay, whatever the entity is called."""
    operator, state, network = (f"hist_mode_{c}" for c in roles.labels)
    own = {"tower_id": roles.entity, "operator": operator, "state": state, "network_type": network}
    return OUTPUT | own


def output(df: DataFrame, roles: Roles = TOWERS, ranked: bool = True) -> DataFrame:
    """Watchlist columns under their output names; ``ranked=False`` leaves the priority out.

    Fails if ``df`` has not all of them.
    """
    wanted = {
        name: source
        for name, source in output_columns(roles).items()
        if ranked or name != "recommended_priority"
    }
    missing = [c for c in wanted.values() if c not in df.columns]
    if missing:
        raise ValueError(f"the watchlist lacks the columns {missing}")
    return df.select(*[F.col(source).alias(name) for name, source in wanted.items()])


def validate(watch: DataFrame, rows: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Does the list have every entity of ``rows`` exactly once?"""
    listed = watch.agg(
        F.count(F.lit(1)).alias("listed_rows"),
        F.count_distinct("tower_id").alias("listed_towers"),
    )
    expected = rows.agg(F.count_distinct(roles.entity).alias("towers"))
    return listed.crossJoin(F.broadcast(expected)).select(
        "*",
        (F.col("listed_rows") == F.col("towers")).alias("covers_all"),
        (F.col("listed_rows") == F.col("listed_towers")).alias("key_unique"),
    )
