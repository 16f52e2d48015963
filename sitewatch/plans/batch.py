"""The whole run: raw files in, tables, models, watchlist and dashboard out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewatch.operators import clean, dashboard, entity, features, history, model, risk, watchlist
from sitewatch.operators.model import DEFAULTS, ModelConfig
from sitewatch.plans import stages
from sitewatch.roles import TOWERS, Roles
from sitewatch.sources.export import write_csv, write_json_document, write_parquet
from sitewatch.sources.raw import load_raw, with_load_order
from sitewatch.sources.scratch import owned


def build_tables(raw: DataFrame, folder: str, roles: Roles = TOWERS, strict: bool = True) -> None:
    """Clean rows, feature rows and the entity summary, as parquet below ``folder``."""
    spark = raw.sparkSession
    write_parquet(clean.clean(raw, roles, strict), f"{folder}/clean")
    clean_rows = spark.read.parquet(f"{folder}/clean")
    write_parquet(entity.entity_summary(clean_rows, roles), f"{folder}/summary_base")
    summary = risk.add_risk(spark.read.parquet(f"{folder}/summary_base"))
    write_parquet(summary, f"{folder}/summary")
    with_risk = risk.attach_risk(
        features.features(clean_rows, roles), spark.read.parquet(f"{folder}/summary"), roles
    )
    write_parquet(with_risk, f"{folder}/features")


def build_models(
    folder: str, spark: SparkSession, config: ModelConfig = DEFAULTS, roles: Roles = TOWERS
) -> None:
    """Examples, the three fitted models and their evaluation."""
    rows = spark.read.parquet(f"{folder}/features")
    write_parquet(history.history_features(rows, roles), f"{folder}/examples")
    split = history.time_split(spark.read.parquet(f"{folder}/examples"))
    write_parquet(split, f"{folder}/split")
    train = spark.read.parquet(f"{folder}/split").where("NOT is_test")
    test = spark.read.parquet(f"{folder}/split").where("is_test")
    model.save_bundle(model.fit_models(train, config), test, f"{folder}/bundle")


def build_outputs(folder: str, spark: SparkSession, roles: Roles = TOWERS) -> None:
    """Watchlist, observation cube, dashboard document and CSV exports."""
    rows = spark.read.parquet(f"{folder}/features")
    summary = spark.read.parquet(f"{folder}/summary")
    models, metrics, _ = model.load_bundle(spark, f"{folder}/bundle")
    logistic, forest = models["Logistic Regression"], models["Random Forest"]
    write_parquet(stages.watch_table(logistic, rows, roles), f"{folder}/watchlist")
    watch = spark.read.parquet(f"{folder}/watchlist")
    dictionary = dashboard.materialised_legends(rows, roles)
    for name, table in dictionary.items():
        write_parquet(table, f"{folder}/legends/{name}")
    write_parquet(dashboard.observation_cube(rows, dictionary, roles), f"{folder}/cube")
    write_parquet(dashboard.crosstab(watch, summary, dictionary, roles), f"{folder}/crosstab")
    cross = spark.read.parquet(f"{folder}/crosstab")
    write_parquet(dashboard.document_parts(dictionary, cross), f"{folder}/dashboard_chunks")
    parts = spark.read.parquet(f"{folder}/dashboard_chunks")
    document = dashboard.document(
        parts,
        dashboard.tower_table(dashboard.leaderboard(summary, roles=roles), dictionary, roles),
        dashboard.tower_stats(summary),
        dashboard.watch_top(watch, dictionary),
        dashboard.watch_stats(watch),
        model.importance(forest, spark.read.parquet(f"{folder}/examples")),
        metrics,
    )
    write_json_document(document, f"{folder}/dashboard")
    write_json_document(dashboard.later_parts(parts), f"{folder}/dashboard_parts")
    write_csv(spark.read.parquet(f"{folder}/clean"), f"{folder}/csv/clean")
    write_csv(rows.select(*features.EXPORT_COLUMNS), f"{folder}/csv/features", [roles.row])
    write_csv(summary, f"{folder}/csv/summary")
    write_csv(watch, f"{folder}/csv/watchlist")


def run(
    spark: SparkSession,
    raw_path: str,
    folder: str,
    config: ModelConfig = DEFAULTS,
    roles: Roles = TOWERS,
    strict: bool = True,
) -> DataFrame:
    """Everything from the raw CSV at ``raw_path``; returns the watchlist validation.

    Every stage writes its table below ``folder`` and the next one reads it, so a run can be
    taken up again after any stage and no result depends on the memory of one machine. Scratch
    tables are dropped at the end.
    """
    with owned(spark):
        build_tables(with_load_order(load_raw(spark, raw_path)), folder, roles, strict)
        build_models(folder, spark, config, roles)
        build_outputs(folder, spark, roles)
    return watchlist.validate(
        spark.read.parquet(f"{folder}/watchlist"), spark.read.parquet(f"{folder}/clean"), roles
    )
