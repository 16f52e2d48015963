"""Ranges, quantiles, outliers, histograms and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.functions.numeric import mean, pearson
from sitewatch.operators.quantiles import exact_quantiles

# Bins that a task makes in a row.
BIN_RUN = 1 << 16


def _typed(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    return df.select(*[c.cast("double").alias(name) for name, c in measures.items()])


def percentiles(
    df: DataFrame, measures: dict[str, Column], wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """One row of exact interpolated percentiles; ``wanted`` maps output to (measure, fraction)."""
    fractions = sorted({p for _, p in wanted.values()})
    found = exact_quantiles(_typed(df, measures), list(measures), fractions)
    return found.select(
        *[F.col(m)[fractions.index(p)].alias(name) for name, (m, p) in wanted.items()]
    )


def iqr_fences(df: DataFrame, measures: dict[str, Column], k: float = 1.5) -> DataFrame:
    """One row with ``q1_, q3_, iqr_, lower_fence_, upper_fence_`` of every measure."""
    quartiles = exact_quantiles(_typed(df, measures), list(measures), [0.25, 0.75])
    columns = []
    for name in measures:
        q1, q3 = F.col(name)[0], F.col(name)[1]
        columns += [
            q1.alias(f"q1_{name}"),
            q3.alias(f"q3_{name}"),
            (q3 - q1).alias(f"iqr_{name}"),
            (q1 - k * (q3 - q1)).alias(f"lower_fence_{name}"),
            (q3 + k * (q3 - q1)).alias(f"upper_fence_{name}"),
        ]
    return quartiles.select(*columns)


def iqr_outliers(df: DataFrame, measures: dict[str, Column], k: float = 1.5) -> DataFrame:
    """Rows strictly outside the fences, per measure, all measures in one pass.

    The fences are one row, so the cross join broadcasts one row.
    """
    fences = iqr_fences(df, measures, k)
    return df.crossJoin(F.broadcast(fences)).agg(
        *[
            F.count_if(
                (value.cast("double") < F.col(f"lower_fence_{name}"))
                | (value.cast("double") > F.col(f"upper_fence_{name}"))
            ).alias(f"outliers_{name}")
            for name, value in measures.items()
        ]
    )


def boxplot(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Per measure: quartiles, the most extreme values inside the fences, outlier count."""
    typed = _typed(df, {c: F.col(c) for c in columns})
    quartiles = exact_quantiles(typed, columns, [0.25, 0.5, 0.75])
    summary = quartiles.select(*[F.col(c).alias(f"_q_{c}") for c in columns])
    inside = {}
    for c in columns:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[2]
        inside[c] = (F.col(c) >= q1 - k * (q3 - q1)) & (F.col(c) <= q3 + k * (q3 - q1))
    one_row = typed.crossJoin(F.broadcast(summary)).agg(
        *[
            F.struct(
                F.min(F.when(inside[c], F.col(c))).alias("whisker_low"),
                F.first(f"_q_{c}")[0].alias("q1"),
                F.first(f"_q_{c}")[1].alias("median"),
                F.first(f"_q_{c}")[2].alias("q3"),
                F.max(F.when(inside[c], F.col(c))).alias("whisker_high"),
                F.count_if(~inside[c]).alias("outliers"),
            ).alias(c)
            for c in columns
        ]
    )
    return one_row.unpivot([], list(columns), "measure", "box").select("measure", "box.*")


def bucket_counts(
    df: DataFrame, value: Column, low: float, high: float, buckets: int
) -> DataFrame:
    """Equal-width buckets over [low, high); 0 and buckets + 1 collect what lies outside."""
    bucket = F.width_bucket(value, F.lit(low), F.lit(high), F.lit(buckets))
    return (
        df.groupBy(bucket.alias("bucket"))
        .agg(
            F.min(value).alias("bucket_min"),
            F.max(value).alias("bucket_max"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy(F.col("bucket").asc_nulls_last())
    )


def histograms(df: DataFrame, bins: dict[str, int | None], empty: bool = True) -> DataFrame:
    """Every bin of every measure, empty ones too unless ``empty`` is false.

    ``bins`` gives the number of equal-width bins between the measure's own minimum and maximum,
    the last one closed, or None for whole numbers: one bin for each from minimum to maximum.
    All measures share one scan for the ranges and one for the counts; rows are counted before
    the shuffle, so at most one row per bin travels. Empty bins, of which a single far value can
    make very many, are made by all tasks in runs of ``BIN_RUN``.
    """
    columns = list(bins)
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    ranges = typed.agg(
        *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_r_{c}") for c in columns]
    )
    numbered = typed.crossJoin(F.broadcast(ranges)).select(
        *[_bin(F.col(c), F.col(f"_r_{c}"), n).alias(c) for c, n in bins.items()]
    )
    counts = (
        numbered.unpivot([], columns, "measure", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("measure", "bin")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    if not empty:
        return counts.select("measure", "bin", F.col("found").alias("n"))
    lasts = ranges.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("measure"), _last_bin(F.col(f"_r_{c}"), n).alias("last"))
                    for c, n in bins.items()
                ]
            )
        )
    )
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), "last", F.lit(BIN_RUN).cast("bigint")))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A fixed number of tasks: by their few bytes the runs would be put into one.
    runs = lasts.select("measure", "last", start.alias("start")).repartition(tasks, "measure", "start")
    stop = F.least(F.col("last"), F.col("start") + (BIN_RUN - 1))
    every = runs.select("measure", F.explode(F.sequence("start", stop)).alias("bin"))
    return every.join(counts, ["measure", "bin"], "left").select(
        "measure", "bin", F.coalesce("found", F.lit(0)).cast("bigint").alias("n")
    )


def _last_bin(limits: Column, bins: int | None) -> Column:
    """Number of the last bin; NULL, so no bins, for a measure without values."""
    if bins is None:
        return (F.floor(limits["hi"]) - F.floor(limits["lo"])).cast("bigint")
    return F.when(limits["lo"].isNotNull(), F.lit(bins - 1).cast("bigint"))


def _bin(value: Column, limits: Column, bins: int | None) -> Column:
    if bins is None:
        return (F.floor(value) - F.floor(limits["lo"])).cast("bigint")
    width = (limits["hi"] - limits["lo"]) / bins
    index = F.floor(F.try_divide(value - limits["lo"], width))
    # A measure without spread has all its rows in the first bin.
    index = F.when(limits["hi"] == limits["lo"], F.lit(0)).otherwise(index)
    return F.least(index, F.lit(bins - 1)).cast("bigint")


def value_tail(
    df: DataFrame, value: Column, above: float, name: str, limit: int = 15
) -> DataFrame:
    """Frequencies of the largest values."""
    return (
        df.where(value > above)
        .groupBy(value.alias(name))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc(name))
        .limit(limit)
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum: one row per measure."""
    one_row = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                mean(c).alias("mean"),
                F.stddev_samp(F.col(c).cast("double")).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    quartiles = exact_quantiles(df.select(*columns), columns, [0.25, 0.5, 0.75])
    figures = one_row.unpivot([], list(columns), "measure", "s")
    places = quartiles.unpivot([], list(columns), "measure", "q")
    # One row per measure on both sides.
    return figures.join(F.broadcast(places), "measure").select(
        "measure", "s.count", "s.mean", "s.std", "s.min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "s.max",
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair as (a, b, r), from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one_row = df.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = []
    for a, b in pairs:
        for left, right in {(a, b), (b, a)}:
            entries.append(
                F.struct(
                    F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"`{a}|{b}`").alias("r")
                )
            )
    return one_row.select(F.inline(F.array(*entries)))


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The same ``n`` rows on every run: those whose seeded key digest is smallest.

    Each partition keeps its own smallest ``n`` before they are merged.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(digest, F.col(key)).limit(n)
