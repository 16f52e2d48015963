"""Compact tables for a dashboard: dictionaries, encoded rows, capped tables, crosstab."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.functions.bands import PROBABILITY_LEVELS, RISK_LEVELS
from sitewatch.operators.ordering import global_position
from sitewatch.roles import TOWERS, Roles
from sitewatch.sources.scratch import frozen

NO_REASON = "None"
# Entries of a dimension, or label combinations, in one chunk.
CHUNK_ROWS = 10_000

# A dictionary table for each dimension: code and value.
Dictionary = Mapping[str, DataFrame]


def _dimensions(roles: Roles) -> dict[str, Column]:
    operator, state, network = roles.labels
    return {
        "operators": F.col(operator),
        "networks": F.col(network),
        "states": F.col(state),
        "cities": F.col(roles.place),
        "reasons": F.coalesce(F.col(roles.reason), F.lit(NO_REASON)),
        "dates": F.date_format(roles.day, "yyyy-MM-dd"),
    }


def legends(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Code (from 0) of every value of the six dimensions, in sort order.

    All dimensions come from one scan and only distinct values are shuffled. "None" leads the
    reasons whether or not a reason is missing.
    """
    dimensions = _dimensions(roles)
    found = df.select(*[c.alias(name) for name, c in dimensions.items()]).unpivot(
        [], list(dimensions), "dimension", "value"
    )
    none = df.sparkSession.range(1).select(F.lit("reasons"), F.lit(NO_REASON))
    values = found.where(F.col("value").isNotNull()).distinct().union(none).distinct()
    first = (F.col("dimension") == "reasons") & (F.col("value") == NO_REASON)
    # Numbered over all tasks: a dimension may have any number of values.
    order = [F.col("dimension"), (~first).cast("int"), F.col("value")]
    placed = global_position(values, order, "_place")
    starts = placed.groupBy("dimension").agg(F.min("_place").alias("_start"))
    return placed.join(F.broadcast(starts), "dimension").select(  # one row per dimension
        "dimension", (F.col("_place") - F.col("_start")).cast("int").alias("code"), "value"
    )


def encode(df: DataFrame, dictionary: Dictionary, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds code columns: ``columns`` maps output name to (dimension, value).

    Every dimension is a written table of its own, whose size is known, so Spark broadcasts it
    exactly when it is small enough, whatever the size of the others. A value without entry gets
    NULL, no row is lost.
    """
    for name, (dimension, value) in columns.items():
        entries = dictionary[dimension].select(
            F.col("code").alias(name), F.col("value").alias(f"_{name}")
        )
        df = df.join(entries, value == F.col(f"_{name}"), "left").drop(f"_{name}")
    return df


def fixed_point(value: Column, digits: int) -> Column:
    """Decimal value as an integer with ``digits`` implied decimals, rounding half to even."""
    return (F.bround(value, digits) * 10**digits).cast("int")


def observation_cube(df: DataFrame, dictionary: Dictionary, roles: Roles = TOWERS) -> DataFrame:
    """Every observation as small integers; stays distributed."""
    d = _dimensions(roles)
    codes = {
        "d": "dates", "op": "operators", "nt": "networks", "st": "states", "ct": "cities",
        "rs": "reasons",
    }
    coded = encode(df, dictionary, {name: (dim, d[dim]) for name, dim in codes.items()})
    return coded.select(
        roles.row, *codes,
        fixed_point(F.col(roles.uptime), 1).alias("up"),
        fixed_point(F.col(roles.downtime), 1).alias("dt"),
        F.col(roles.outages).cast("int").alias("oc"),
        F.col(roles.users).cast("int").alias("ua"),
    )


def leaderboard(summary: DataFrame, n: int = 400, roles: Roles = TOWERS) -> DataFrame:
    """The ``n`` entities of lowest uptime and the ``n`` repeat entities hit most, once each.

    Both lists are top-n selections, so at most ``2 n`` rows reach the de-duplication.
    """
    worst = summary.orderBy("avg_uptime_percentage", roles.entity).limit(n)
    repeat = (
        summary.where(F.col("repeat_outage_indicator") == 1)
        .orderBy(F.desc("impactful_outage_observations"), roles.entity)
        .limit(n)
    )
    return worst.unionByName(repeat).dropDuplicates([roles.entity])


def tower_table(board: DataFrame, dictionary: Dictionary, roles: Roles = TOWERS) -> DataFrame:
    """Leaderboard rows with dictionary codes and whole numbers."""
    operator, state, network = (F.col(f"mode_{c}") for c in roles.labels)
    coded = encode(
        board.withColumnRenamed("city", "_city"), dictionary,
        {
            "ct": ("cities", F.col("_city")), "op": ("operators", operator),
            "st": ("states", state), "nt": ("networks", network),
        },
    )
    return coded.select(
        F.col(roles.entity).alias("id"), "ct", "op", "st", "nt",
        F.col("total_observations").alias("obs"),
        fixed_point(F.col("avg_uptime_percentage"), 2).alias("up"),
        F.bround("total_downtime_minutes", 0).cast("bigint").alias("dtot"),
        F.col("total_users_affected").alias("utot"),
        F.col("impactful_outage_observations").alias("impc"),
        F.col("repeat_outage_indicator").alias("rep"),
    )


def tower_stats(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("total_towers"),
        F.count_if(F.col("repeat_outage_indicator") == 1).alias("repeat_outage_towers"),
    )


def watch_top(watch: DataFrame, dictionary: Dictionary, n: int = 500) -> DataFrame:
    """The first ``n`` watchlist rows with dictionary codes."""
    top = watch.orderBy("recommended_priority").limit(n)
    coded = encode(
        top, dictionary,
        {
            "op": ("operators", F.col("operator")), "st": ("states", F.col("state")),
            "ct": ("cities", F.col("city")), "nt": ("networks", F.col("network_type")),
        },
    )
    return coded.select(
        F.col("tower_id").alias("id"), "op", "st", "ct", "nt",
        fixed_point(F.col("latest_uptime"), 2).alias("lu"),
        F.bround("historical_total_downtime_minutes", 0).cast("bigint").alias("td"),
        F.col("historical_total_outage_count").alias("to"),
        F.bround("site_reliability_risk_score", 1).alias("score"),
        F.col("risk_category_final").alias("rc"),
        F.bround(F.col("predicted_risk_probability") * 10000, 0).cast("int").alias("prob"),
        F.col("predicted_risk_category").alias("pc"),
        F.col("recommended_priority").alias("pri"),
    )


def watch_stats(watch: DataFrame) -> DataFrame:
    """Totals of the whole watchlist in one row, with the entities per final category."""
    band, category = F.col("predicted_risk_category"), F.col("risk_category_final")
    return watch.agg(
        F.count(F.lit(1)).alias("total_towers"),
        F.count_if(band.isin(*PROBABILITY_LEVELS[2:])).alias("predicted_high_or_critical"),
        F.round(F.avg("predicted_risk_probability"), 4).alias("avg_predicted_probability"),
        *[F.count_if(category == c).alias(_short(c)) for c in RISK_LEVELS],
    )


def _short(category: str) -> str:
    return category.split()[0].lower() + "_risk"


def crosstab(
    watch: DataFrame, summary: DataFrame, dictionary: Dictionary, roles: Roles = TOWERS
) -> DataFrame:
    """Operator x network x state over all entities: categories, bands, probability sum."""
    flags = summary.select(F.col(roles.entity).alias("tower_id"), "repeat_outage_indicator")
    rows = watch.join(flags, "tower_id")
    category, band = F.col("risk_category_final"), F.col("predicted_risk_category")
    short = ("low", "med", "high", "crit")
    groups = rows.groupBy("operator", "network_type", "state").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("repeat_outage_indicator").alias("repeat"),
        *[F.count_if(category == c).alias(s) for s, c in zip(short, RISK_LEVELS)],
        *[F.count_if(band == b).alias(f"p_{s}") for s, b in zip(short, PROBABILITY_LEVELS)],
        F.round(F.sum("predicted_risk_probability"), 3).alias("prob_sum"),
    )
    # The groups are encoded, not the entities: there are only as many as label combinations.
    coded = encode(
        groups, dictionary,
        {
            "op": ("operators", F.col("operator")), "nt": ("networks", F.col("network_type")),
            "st": ("states", F.col("state")),
        },
    )
    counts = [*short, *[f"p_{s}" for s in short]]
    return coded.select("op", "nt", "st", "n", "repeat", *counts, "prob_sum")


def columnar(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """A capped table as one struct of parallel arrays, rows in ``order``."""
    columns = [*order, *[c for c in df.columns if c not in order]]
    rows = df.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    # A field of an array of structs is the array of that field.
    arrays = [F.col("rows").getField(c).alias(c) for c in df.columns]
    return rows.select(F.struct(*arrays).alias(name))


def document_parts(dictionary: Dictionary, cross: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Every entry of the dictionaries and every row of the crosstab, in chunks of ``size``.

    ``part`` is a dimension or "crosstab"; chunk ``k`` has the codes, or the places in the order of
    the codes, from ``k * size``. Entries are in ``entries``, crosstab rows are parallel arrays in
    ``crosstab``. A group is a chunk, so parts of any length are made by all tasks.
    """
    tables = [t.select(F.lit(name).alias("part"), "code", "value") for name, t in dictionary.items()]
    entries = (
        reduce(DataFrame.unionByName, tables)
        .groupBy("part", F.expr(f"code div {size}").alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("code", "value"))).alias("rows"))
        .select("part", "chunk", F.col("rows").getField("value").alias("entries"))
    )
    # Nulls first among the codes; label combinations, and so these orders, have no ties.
    placed = global_position(cross, [F.col(c) for c in ("op", "nt", "st")], "_place")
    rows = placed.groupBy(F.expr(f"(_place - 1) div {size}").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("_place", *cross.columns))).alias("rows")
    )
    arrays = [F.col("rows").getField(c).alias(c) for c in cross.columns]
    chunks = rows.select(F.lit("crosstab").alias("part"), "chunk", F.struct(*arrays).alias("crosstab"))
    return entries.unionByName(chunks, allowMissingColumns=True)


def document(
    parts: DataFrame,
    board: DataFrame,
    stats: DataFrame,
    top: DataFrame,
    top_stats: DataFrame,
    importances: DataFrame,
    model_metrics: DataFrame,
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """One row with everything a dashboard loads first.

    ``parts`` are those of ``document_parts``, written. The document holds the first chunk of each
    and tells in ``chunks`` how many there are; ``later_parts`` are written beside it, so
    the two hold every entry. Other tables are capped ones, whole.
    """
    first = parts.where("chunk = 0")
    legend = first.where("part <> 'crosstab'").agg(
        F.map_from_entries(F.collect_list(F.struct("part", "entries"))).alias("legends")
    )
    fields = parts.schema["crosstab"].dataType.fields
    none = F.struct(*[F.array().cast(f.dataType).alias(f.name) for f in fields])
    cross = first.where("part = 'crosstab'").agg(
        F.coalesce(F.first("crosstab"), none).alias("crosstab")
    )
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a part
    chunks = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("chunks"),
        F.lit(size).alias("chunk_rows"),
    )
    cells = ("tn", "fp", "fn", "tp")
    figures = [
        *[F.col(c) for c in model_metrics.columns if c not in ("model", *cells)],
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
    ]
    categories = {c: _short(c) for c in RISK_LEVELS}
    per_category = F.create_map(
        *[x for c, short in categories.items() for x in (F.lit(c), F.col(short))]
    )
    totals = [c for c in top_stats.columns if c not in categories.values()]
    parts = [
        columnar(board, "tw", ["up", "id"]),
        stats.select(F.struct(*stats.columns).alias("tw_stats")),
        columnar(top, "wl", ["pri"]),
        top_stats.select(
            F.struct(*totals, per_category.alias("risk_category_counts")).alias("wl_stats")
        ),
        cross,
        chunks,
        importances.agg(
            F.collect_list(F.struct("feature", "importance")).alias("feat_importance")
        ),
        model_metrics.agg(
            F.map_from_entries(
                F.collect_list(F.struct("model", F.struct(*figures)))
            ).alias("model_metrics")
        ),
    ]
    result = legend
    for part in parts:
        result = result.crossJoin(F.broadcast(part))
    return result


def later_parts(parts: DataFrame) -> DataFrame:
    """The chunks that are not in the document."""
    return parts.where("chunk > 0")


_ENTRIES = "part string, chunk bigint, entries array<string>"


def _read(
    spark: SparkSession, path: str, later: str, inside: str, schema: str
) -> tuple[DataFrame, DataFrame]:
    """The document at ``path``, as far as ``inside`` names it, and the parts beside it."""
    found = spark.read.schema(f"chunk_rows bigint, {inside}").json(path)
    beside = spark.read.schema(schema).json(later)
    size = F.broadcast(found.select("chunk_rows"))  # one row
    return found, beside.crossJoin(size)


def read_legends(spark: SparkSession, path: str, later: str) -> DataFrame:
    """``(dimension, code, value)`` of a written document and the parts beside it."""
    found, beside = _read(spark, path, later, "legends map<string, array<string>>", _ENTRIES)
    first = found.select(F.explode("legends").alias("part", "entries"), F.lit(0).alias("chunk"), "chunk_rows")
    return (
        first.unionByName(beside.where("part <> 'crosstab'"))
        .select("part", "chunk", "chunk_rows", F.posexplode("entries").alias("at", "value"))
        .select(
            F.col("part").alias("dimension"),
            (F.col("chunk") * F.col("chunk_rows") + F.col("at")).cast("int").alias("code"),
            "value",
        )
    )


def read_crosstab(spark: SparkSession, path: str, later: str, columns: Mapping[str, str]) -> DataFrame:
    """Crosstab rows of a written document and the parts beside it; ``columns`` gives their types."""
    arrays = ", ".join(f"{c}: array<{kind}>" for c, kind in columns.items())
    inside = f"crosstab struct<{arrays}>"
    found, beside = _read(spark, path, later, inside, f"part string, {inside}")
    every = found.select("crosstab").union(beside.where("part = 'crosstab'").select("crosstab"))
    zipped = F.arrays_zip(*[F.col("crosstab").getField(c).alias(c) for c in columns])
    return every.select(F.inline(zipped)).toDF(*columns)


def materialised_legends(df: DataFrame, roles: Roles = TOWERS) -> Dictionary:
    """Every dimension's dictionary written once; an encoding then reads its entries only."""
    found = frozen(legends(df, roles))
    return {
        name: frozen(found.where(F.col("dimension") == name).select("code", "value"))
        for name in _dimensions(roles)
    }
