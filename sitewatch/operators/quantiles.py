"""Exact quantiles by selection: narrow down what can stand at a rank until one value is left."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from math import ceil, floor, isnan, nan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ranks that a sketch tells apart: each round leaves about a 2500th of the values in question.
ACCURACY = 10_000

# What is known of a rank: it is strictly between two values (None: no limit yet), of which
# ``below`` rows are at or under the first, and ``inside`` rows between both.
_Open = tuple[float | None, float | None, int, int]


def _between(value: Column, low: float | None, high: float | None) -> Column:
    inside = F.lit(True)
    if low is not None:
        inside = inside & (value > F.lit(low))
    if high is not None:
        inside = inside & (value < F.lit(high))
    return F.when(inside, value)


def _probes(typed: DataFrame, wanted: dict[str, dict[int, _Open]]) -> dict[str, set[float]]:
    """Values near every open rank and at both its sides, out of sketches of what is between its
    limits. One aggregate; no rows are shuffled, only sketches."""
    aside = 2 / ACCURACY
    places: dict[tuple, list[float]] = defaultdict(list)
    for c, ranks in wanted.items():
        for rank, (low, high, below, inside) in ranks.items():
            at = (rank - below + 0.5) / inside
            places[c, low, high] += [max(at - aside, 0.0), at, min(at + aside, 1.0)]
    row = typed.agg(
        *[
            F.percentile_approx(_between(F.col(c), low, high), sorted(set(at)), ACCURACY).alias(f"q{i}")
            for i, ((c, low, high), at) in enumerate(places.items())
        ]
    ).first()
    found: dict[str, set[float]] = defaultdict(set)
    for i, (c, low, high) in enumerate(places):
        found[c] |= {nan if isnan(v) else v for v in (low, high, *row[f"q{i}"]) if v is not None}
    return found


def _counts(typed: DataFrame, probes: dict[str, list[float]]) -> dict[str, dict[int, int]]:
    """Rows of each column by where they are among its probes: under the first (0), equal to it (1),
    between it and the next (2) and so on. Counted before the shuffle, a few rows a column."""

    def place(c: str) -> Column:
        out = F.lit(0)
        for v in probes[c]:
            out = out + (F.col(c) >= F.lit(v)).cast("int") + (F.col(c) > F.lit(v)).cast("int")
        return F.when(F.col(c).isNotNull(), out).alias(c)

    counted = (
        typed.select(*[place(c) for c in probes])
        .unpivot([], list(probes), "measure", "place")
        .where(F.col("place").isNotNull())
        .groupBy("measure", "place")
        .count()
    )
    out: dict[str, dict[int, int]] = defaultdict(dict)
    for r in counted.collect():
        out[r["measure"]][r["place"]] = r["count"]
    return out


def values_at(typed: DataFrame, sizes: dict[str, int], ranks: dict[str, Iterable[int]]) -> dict[str, dict[int, float]]:
    """The value at each rank (from 0) of columns of doubles without their NULLs.

    A round takes probes out of sketches and counts all rows against them. Counts alone decide,
    so a sketch that is off costs a round, never the result: a rank ends at the probe that its rows
    equal, or between two neighbouring ones, of which there are fewer values in every round.
    The driver sees some three numbers a rank.
    """
    found: dict[str, dict[int, float]] = defaultdict(dict)
    wanted = {c: {k: (None, None, 0, sizes[c]) for k in ranks[c]} for c in ranks if sizes[c]}
    while wanted := {c: open_ranks for c, open_ranks in wanted.items() if open_ranks}:
        probes = {c: sorted(v, key=lambda x: (isnan(x), x)) for c, v in _probes(typed, wanted).items()}
        counts = _counts(typed, probes)
        for c, open_ranks in wanted.items():
            left, below = {}, 0
            edges = [None, *probes[c], None]
            for place, n in sorted(counts[c].items()):
                here = [k for k in open_ranks if below <= k < below + n]
                if place % 2:
                    found[c].update((k, edges[place // 2 + 1]) for k in here)
                else:
                    left.update((k, (edges[place // 2], edges[place // 2 + 1], below, n)) for k in here)
                below += n
            wanted[c] = left
    return found


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """One row; each column holds an array with its linearly interpolated quantiles.

    Values are neither sorted nor shuffled: the rows are read once for their number and twice
    a round (one round up to some 5,000 rows, two up to 10^7, three up to 10^10), whatever the ties.
    Pass a table, or what is cheaply made of one. NaN is the largest value. A column without values
    has NULLs.
    """
    names = {f"_{i}": c for i, c in enumerate(columns)}
    # Adding zero makes -0.0 and 0.0 one literal.
    typed = df.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(n) for n, c in names.items()])
    sizes = typed.agg(*[F.count(n).alias(n) for n in names]).first().asDict()
    places = {n: [float(p) * (size - 1) for p in probabilities] for n, size in sizes.items()}
    found = values_at(typed, sizes, {n: {r for x in at for r in (floor(x), ceil(x))} for n, at in places.items()})

    def interpolated(n: str) -> list[float] | None:
        if not sizes[n]:
            return None
        ends = [(found[n][floor(x)], found[n][ceil(x)], x - floor(x)) for x in places[n]]
        return [low if low == high else low + (high - low) * part for low, high, part in ends]

    schema = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in columns])
    return df.sparkSession.createDataFrame([tuple(map(interpolated, names))], schema)
