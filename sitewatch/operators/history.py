"""Leakage-safe history features.

Every observation but an entity's first becomes one example: features over the strictly
earlier rows of the entity, in (day, row) order, and the row's own risk flag as the target.

An entity's rows meet in one task, and one window gives its features: one shuffle. Only entities
with more rows than a task should sort go another way. Their rows are range-sorted over all
tasks by (entity, day, row) and written once, so every task holds one stretch of the order. An
entity that crosses into the next stretch is cut there: what precedes a row is what its
entity's earlier stretches hold, plus what precedes it within its own. There is at most one such
entity for each border between stretches, and no task ever holds more of an entity than a
stretch, however many rows the entity has.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.functions.numeric import mean, share
from sitewatch.operators.features import high_risk
from sitewatch.operators.ordering import sorted_chunks
from sitewatch.roles import TOWERS, Roles
from sitewatch.sources.scratch import frozen

NUMERIC_FEATURES = (
    "hist_num_observations", "hist_avg_uptime", "hist_min_uptime", "hist_avg_downtime",
    "hist_max_downtime", "hist_total_downtime", "hist_avg_outage_count",
    "hist_total_outage_count", "hist_avg_users_affected", "hist_pct_impactful",
)


# Rows of an entity that one task sorts and holds frames of.
HOT_ROWS = 1_000_000


def label_features(roles: Roles = TOWERS) -> tuple[str, ...]:
    return (*[f"hist_mode_{c}" for c in roles.labels], "hist_city")


def _example_columns(roles: Roles) -> list[str]:
    return [
        *NUMERIC_FEATURES, *label_features(roles), roles.entity, roles.row,
        "target_date", "next_period_high_risk",
    ]


def _inputs(df: DataFrame, roles: Roles) -> DataFrame:
    """Columns the features read, of rows with an entity; an empty label is an unknown one."""
    labels = [F.nullif(F.col(c), F.lit("")).alias(c) for c in (roles.place, *roles.labels)]
    return df.where(F.col(roles.entity).isNotNull()).select(
        roles.entity, roles.row, roles.day, *labels, *roles.measures
    )


def history_features(
    df: DataFrame, roles: Roles = TOWERS, latest_only: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Examples of all entities; ``latest_only`` keeps each entity's last one.

    Entities of over ``hot_rows`` rows take another way to the same examples.
    """
    rows = _inputs(df, roles)
    hot = frozen(hot_entities(rows, hot_rows, roles))
    examples = history_by_window(rows.join(hot, roles.entity, "left_anti"), roles)
    if not hot.isEmpty():  # without any, theirs are no examples: leave the empty steps out
        theirs = rows.join(hot, roles.entity, "left_semi")
        examples = examples.unionByName(_history_of_hot(theirs, roles))
    if latest_only:
        last = examples.groupBy(roles.entity).agg(
            F.max(F.struct("target_date", roles.row, *_rest(examples, roles))).alias("e")
        )
        examples = last.select("e.*", roles.entity).select(*_example_columns(roles))
    return examples


def hot_entities(rows: DataFrame, most: int, roles: Roles = TOWERS) -> DataFrame:
    """Entities with more than ``most`` rows: at most one for so many rows of the table.

    Rows are counted before the shuffle, so the hottest entity is a row a task.
    """
    counts = rows.groupBy(roles.entity).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most).select(roles.entity)


def _history_of_hot(rows: DataFrame, roles: Roles) -> DataFrame:
    """Examples of entities of any number of rows.

    Most of a stretch's entities may still end within it; only those that cross need more.
    """
    chunks = sorted_chunks(rows, [F.col(c) for c in (roles.entity, roles.day, roles.row)])
    across = crossing_entities(chunks, roles)
    # One row per border at most.
    inside = chunks.join(F.broadcast(across), roles.entity, "left_anti").drop("_chunk", "_slot")
    cut = chunks.join(F.broadcast(across), roles.entity, "left_semi")
    return history_by_window(inside, roles).unionByName(history_by_chunks(cut, roles))


def crossing_entities(chunks: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """Entities whose rows end one chunk and begin the next: one row per border at most."""
    ends = chunks.groupBy("_chunk").agg(
        F.min(roles.entity).alias("first"), F.max(roles.entity).alias("last")
    )
    before = F.lag("last").over(Window.orderBy("_chunk"))
    return (
        ends.select("first", before.alias("before"))
        .where(F.col("first") == F.col("before"))
        .select(F.col("first").alias(roles.entity))
        .distinct()
    )


def _rest(examples: DataFrame, roles: Roles) -> list[str]:
    return [c for c in examples.columns if c not in (roles.entity, roles.row, "target_date")]


def history_by_window(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    earlier = (
        Window.partitionBy(roles.entity)
        .orderBy(roles.day, roles.row)
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    def average(c: str) -> Column:
        return F.try_divide(F.sum(c).over(earlier).cast("double"), F.count(c).over(earlier))

    seen = F.count(F.lit(1)).over(earlier)
    impactful = F.count(F.when(F.col(roles.users) > 0, 1)).over(earlier)
    features = {
        "hist_num_observations": seen,
        "hist_avg_uptime": average(roles.uptime),
        "hist_min_uptime": F.min(roles.uptime).over(earlier),
        "hist_avg_downtime": average(roles.downtime),
        "hist_max_downtime": F.max(roles.downtime).over(earlier),
        "hist_total_downtime": F.sum(roles.downtime).over(earlier),
        "hist_avg_outage_count": average(roles.outages),
        "hist_total_outage_count": F.sum(roles.outages).over(earlier),
        "hist_avg_users_affected": average(roles.users),
        "hist_pct_impactful": F.try_divide(impactful.cast("double"), seen),
        **{f"hist_mode_{c}": F.mode(c, True).over(earlier) for c in roles.labels},
        "hist_city": F.first(roles.place).over(earlier),
    }
    return (
        df.select("*", *[f.alias(name) for name, f in features.items()])
        .where(F.col("hist_num_observations") > 0)
        .select(
            *features, roles.entity, roles.row, F.col(roles.day).alias("target_date"),
            high_risk(roles).alias("next_period_high_risk"),
        )
    )


# How two partial results of the same aggregate become one.
_MERGE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def strictly_before(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    parts: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Adds, per part, the aggregate over all rows of the group earlier in ``order``.

    ``parts`` maps output name to a kind ("sum", "min" or "max") and the value aggregated. Rows
    are in chunks (``_chunk``) that follow the order. No window sees a whole group: one runs
    over the chunks it is in, one over its rows in a chunk.
    """
    names = list(parts)
    rows = df.withColumns({f"_v_{n}": parts[n][1] for n in names})

    def total(n: str, source: str) -> Column:
        return _MERGE[parts[n][0]][0](source)

    def over(n: str, source: str, by: Sequence[str], within: Sequence[str]) -> Column:
        frame = Window.partitionBy(*by).orderBy(*within)
        return total(n, source).over(frame.rowsBetween(Window.unboundedPreceding, -1))

    chunks = rows.groupBy(*group, "_chunk").agg(
        *[total(n, f"_v_{n}").alias(f"_t_{n}") for n in names]
    )
    keys = [*group, "_chunk"]
    carried = chunks.select(
        *[F.col(k).alias(f"_g_{k}") for k in keys],
        *[over(n, f"_t_{n}", group, ["_chunk"]).alias(f"_c_{n}") for n in names],
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])

    def merged(n: str) -> Column:
        return _MERGE[parts[n][0]][1](F.col(f"_c_{n}"), over(n, f"_v_{n}", keys, order))

    return rows.join(carried, same).select(*df.columns, *[merged(n).alias(n) for n in names])


def history_by_chunks(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """The same examples as ``history_by_window`` for entities in any number of chunks.

    The most frequent earlier label comes from occurrence numbers: the k-th row with a label
    carries k, so over the earlier rows the highest k belongs to the most frequent label, and
    of several such labels the smallest is taken. Both steps are sums and minimums, which
    chunks can pass on.
    """
    entity, day, row = roles.entity, roles.day, roles.row
    rows = df
    for c in roles.labels:
        rows = strictly_before(rows, [entity, c], [day, row], {f"_seen_{c}": ("sum", F.lit(1))})
    # Read twice from here on.
    rows = frozen(rows)
    parts: dict[str, tuple[str, Column]] = {
        "_n": ("sum", F.lit(1)),
        "_hit": ("sum", F.when(F.col(roles.users) > 0, 1)),
        "_min_uptime": ("min", F.col(roles.uptime)),
        "_max_downtime": ("max", F.col(roles.downtime)),
        "_first": ("min", F.struct(F.col(day), F.col(row), F.col(roles.place).alias("place"))),
    }
    for c in roles.measures:
        parts[f"_sum_{c}"] = ("sum", F.col(c))
        parts[f"_known_{c}"] = ("sum", F.when(F.col(c).isNotNull(), 1).otherwise(0))
    for c in roles.labels:
        occurrence = F.struct(
            (-(F.coalesce(f"_seen_{c}", F.lit(0)) + 1)).alias("k"), F.col(c).alias("label")
        )
        parts[f"_mode_{c}"] = ("min", F.when(F.col(c).isNotNull(), occurrence))
    before = strictly_before(rows, [entity], [day, row], parts)

    def average(c: str) -> Column:
        return F.try_divide(F.col(f"_sum_{c}").cast("double"), F.col(f"_known_{c}"))

    hits = F.coalesce("_hit", F.lit(0)).cast("double")
    features = {
        "hist_num_observations": F.col("_n"),
        "hist_avg_uptime": average(roles.uptime),
        "hist_min_uptime": F.col("_min_uptime"),
        "hist_avg_downtime": average(roles.downtime),
        "hist_max_downtime": F.col("_max_downtime"),
        "hist_total_downtime": F.col(f"_sum_{roles.downtime}"),
        "hist_avg_outage_count": average(roles.outages),
        "hist_total_outage_count": F.col(f"_sum_{roles.outages}"),
        "hist_avg_users_affected": average(roles.users),
        "hist_pct_impactful": F.try_divide(hits, F.col("_n")),
        **{f"hist_mode_{c}": F.col(f"_mode_{c}")["label"] for c in roles.labels},
        "hist_city": F.col("_first")["place"],
    }
    return before.where(F.col("_n") > 0).select(
        *[f.alias(name) for name, f in features.items()],
        entity, row, F.col(day).alias("target_date"),
        high_risk(roles).alias("next_period_high_risk"),
    )


def full_history(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """The same features over all rows of every entity, with its latest uptime and day.

    One aggregation by entity; first and last known values are picked by (day, row).
    """
    when = F.struct(roles.day, roles.row)

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), when)

    return _inputs(df, roles).groupBy(roles.entity).agg(
        F.count(F.lit(1)).alias("hist_num_observations"),
        mean(roles.uptime).alias("hist_avg_uptime"),
        F.min(roles.uptime).alias("hist_min_uptime"),
        mean(roles.downtime).alias("hist_avg_downtime"),
        F.max(roles.downtime).alias("hist_max_downtime"),
        F.sum(roles.downtime).alias("hist_total_downtime"),
        mean(roles.outages).alias("hist_avg_outage_count"),
        F.sum(roles.outages).alias("hist_total_outage_count"),
        mean(roles.users).alias("hist_avg_users_affected"),
        share(F.col(roles.users) > 0).alias("hist_pct_impactful"),
        *[F.mode(c, True).alias(f"hist_mode_{c}") for c in roles.labels],
        F.min_by(roles.place, known(roles.place)).alias("hist_city"),
        F.max_by(roles.uptime, known(roles.uptime)).alias("latest_uptime"),
        F.max(roles.day).alias("latest_date"),
    )


def observation_counts(df: DataFrame, roles: Roles = TOWERS) -> DataFrame:
    """How many entities can supply examples and how many were seen only once."""
    known = df.where(F.col(roles.entity).isNotNull())
    counts = known.groupBy(roles.entity).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count_if(F.col("n") >= 2).alias("modelable_towers"),
        F.count_if(F.col("n") == 1).alias("single_observation_towers"),
    )


def dataset_stats(examples: DataFrame) -> DataFrame:
    """Examples and positives by history length, with the date range.

    Totals over these few rows give the size and base rate of the dataset.
    """
    return (
        examples.groupBy("hist_num_observations")
        .agg(
            F.count(F.lit(1)).alias("examples"),
            F.sum("next_period_high_risk").alias("positives"),
            F.avg("next_period_high_risk").alias("base_rate"),
            F.min("target_date").alias("first_target"),
            F.max("target_date").alias("last_target"),
        )
        .orderBy("hist_num_observations")
    )


def split_date(examples: DataFrame, day: str = "target_date", fraction: float = 0.8) -> DataFrame:
    """One row: the date at position ``floor(fraction * n)`` of the examples in date order.

    It is found on the per-date counts, so the running count runs over one row per calendar
    day, whatever the number of examples.
    """
    per_day = examples.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    until = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = per_day.select(
        day,
        F.sum("n").over(until).alias("until"),
        F.floor(F.sum("n").over(everything) * F.lit(fraction)).alias("cut"),
    )
    return placed.where(F.col("until") > F.col("cut")).agg(F.min(day).alias("split_date"))


def time_split(examples: DataFrame, day: str = "target_date", fraction: float = 0.8) -> DataFrame:
    """Adds ``split_date`` and ``is_test``: the last ``1 - fraction`` of the examples by date.

    All rows of the split date are test rows. Pass materialised examples: they are read for
    the split date and again for the rows.
    """
    split = split_date(examples, day, fraction)
    return examples.crossJoin(F.broadcast(split)).withColumn(
        "is_test", F.col(day) >= F.col("split_date")
    )


def split_stats(split: DataFrame) -> DataFrame:
    """Size, date range and target rate of both sides of a time split."""
    return split.groupBy("is_test").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("target_date").alias("first_target"),
        F.max("target_date").alias("last_target"),
        F.avg("next_period_high_risk").alias("target_rate"),
        F.min("split_date").alias("split_date"),
    )
