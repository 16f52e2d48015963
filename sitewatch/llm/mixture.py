"""Mixing sources to target weights: whole passes, then a subset whose sizes sum to the rest.

Documents are counted by exact size within each source. What whole passes leave is drawn evenly
over all documents in the order of their sizes, but for a small rest. Bounded-knapsack dynamic
programming over what is left of each size, in a seeded order, then meets the rest to the word,
where some subset does; it draws a document again only where those not drawn cannot meet it.
The counts are filled with documents in a seeded order.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.llm.arrow import require
from sitewatch.operators.ordering import global_position
from sitewatch.sources.scratch import frozen

# Of the words that whole passes leave, one in so many is left to the dynamic programming, but at
# most so many words, and never less than two of the longest documents.
EVENLY, REST_WORDS = 16, 1 << 15


def word_count(text: str) -> Column:
    """Runs of characters other than blanks and tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, ceiling: float
) -> DataFrame:
    """Adds ``target`` to one row ``(source, source_size)`` per source.

    Sources by code point, null last, take the weights in turn. Together they get ``share`` of
    all sizes. A source's target stops at ``ceiling`` times its size, and the excess goes to the
    others by weight until none is above: the targets are ``min(limit, level * weight)``. The
    level is the largest of those that follow when the sources that fill up first are full.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn(
        "w", F.get(wheel, (F.row_number().over(by_name) - 1) % len(weights))
    ).withColumn("top", ceiling * F.col("source_size").cast("double"))
    fills = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(everything) * share
    rows = rows.select(
        "source", "source_size", "w", "top",
        (
            (wanted - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
            / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        ).alias("level"),
    )
    return rows.select(
        "source", "source_size",
        F.least("top", F.max("level").over(everything) * F.col("w")).alias("target"),
    )


def exact_subset(
    sizes: list[int], free: list[int], budget: int, order: Sequence[int] | None = None
) -> list[int]:
    """How many of each size to take, at most ``free`` of each, so that they sum to ``budget``.

    If no choice does, the sum is the largest one below. Sizes come in ``order`` (places of the
    sizes), longest first without it. Bit s of ``reached`` says that some choice among the items
    so far sums to s; every sum remembers the item that first reached it. Memory is a few bytes
    for each word of the budget.
    """
    taken = [0] * len(sizes)
    longest = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    items = []  # sizes with halving multiplicities: any number up to the free one is a sum of them
    for i in longest if order is None else order:
        left = min(free[i], budget // sizes[i] if sizes[i] else 0)
        step = 1
        while left > 0:
            items.append((i, min(step, left)))
            left -= min(step, left)
            step *= 2
    reached, mask = 1, (1 << (budget + 1)) - 1
    first = np.full(budget + 1, -1, np.int32)
    for number, (i, times) in enumerate(items):
        new = (reached << (sizes[i] * times)) & mask & ~reached
        if new:
            raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
            first[np.flatnonzero(np.unpackbits(raw, bitorder="little"))] = number
            reached |= new
            if reached >> budget & 1:
                break
    at = reached.bit_length() - 1
    while at:
        i, times = items[first[at]]
        taken[i] += times
        at -= sizes[i] * times
    return taken


def even_draw(n: list[int], words: int, total: int, start: int) -> list[int]:
    """Of all documents in the order of their sizes, every ``total / words``-th one.

    The sizes of those drawn sum to ``words`` within the size of the longest document.
    """
    ends = [0]
    for count in n:
        ends.append(ends[-1] + count)
    places = [(end * words + start) // total for end in ends]  # exact: integers
    return [b - a for a, b in zip(places, places[1:])]


def plan_source(counts: pd.DataFrame, ceiling: float, seed: int = 7) -> pd.DataFrame:
    """``passes`` and ``picks`` of every size, from one source's rows ``(size, n, target, ...)``."""
    counts = counts.sort_values("size")
    size, n = counts["size"].tolist(), counts["n"].tolist()
    total = int(counts["source_size"].iloc[0])
    budget = min(int(round(counts["target"].iloc[0])), int(ceiling * total))
    passes, rest = divmod(budget, total) if total else (0, 0)
    name = counts["source"].iloc[0] if "source" in counts else None
    rng = np.random.default_rng([seed, zlib.crc32(name.encode()) if isinstance(name, str) else 0])
    words = max(0, rest - max(2 * size[-1], min(REST_WORDS, rest // EVENLY)))
    base = even_draw(n, words, total, int(rng.integers(total))) if words else [0] * len(n)
    left = rest - sum(b * s for b, s in zip(base, size))
    # A document may be picked once more than others, as long as it stays below the ceiling.
    free = [max(0, (int(ceiling) - passes) * k - b) for k, b in zip(n, base)]
    unused = [min(f, k - b) for f, k, b in zip(free, n, base)]
    order = rng.permutation(len(n)).tolist()
    more = exact_subset(size, unused, left, order)
    if sum(m * s for m, s in zip(more, size)) < left:
        again = [f - u for f, u in zip(free, unused)]
        twice = exact_subset(size * 2, unused + again, left, order + [i + len(n) for i in order])
        more = [a + b for a, b in zip(twice[: len(n)], twice[len(n) :])]
    picks = [b + m for b, m in zip(base, more)]
    return counts.assign(passes=passes, picks=np.array(picks, np.int64))


def mix(
    docs: DataFrame,
    size: str,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2,
    seed: int = 7,
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``copies``: how often the mix takes each row.

    ``size`` names a column of whole numbers; a null size is zero. A null source is a source of
    its own. No row is taken more often than ``ceiling`` times. The order within a size is by a
    hash of seed and key, then by key, so reruns agree; rows that agree in key, source and size
    are interchangeable. An empty table stays empty.

    The counts of a source, one for each different size, are planned in one task; rows never
    are: their places come from a range sort over all tasks, so equal sizes may be any number.
    """
    require(docs, size, key, source)
    if share > ceiling:
        raise ValueError("the mix cannot take more than every source allows")
    names = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    rows = frozen(docs.select(*names, F.monotonically_increasing_id().alias("_row")))
    # Read from the frozen rows, whose other columns are left out; not written once more.
    narrow = rows.select(
        "_row", F.col(source).alias("source"), F.col(key).alias("key"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(key)).alias("h"),
    )
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = frozen(source_targets(sizes, weights, share, ceiling))
    order = [F.col(c) for c in ("source", "size", "h", "key", "_row")]
    placed = global_position(narrow, order, "place")
    counts = placed.groupBy("source", "size").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first")
    )
    same_source = F.col("counts.source").eqNullSafe(F.col("targets.source"))
    counts = counts.alias("counts").join(targets.alias("targets"), same_source)
    plan = frozen(
        counts.select("counts.*", "source_size", "target")
        .groupBy("source")
        .applyInPandas(
            lambda part: plan_source(part, ceiling, seed),
            "source string, size long, n long, first long, source_size long, target double, "
            "passes long, picks long",
        )
    )
    same = F.col("placed.source").eqNullSafe(F.col("plan.source")) & (
        F.col("placed.size") == F.col("plan.size")
    )
    # Picks beyond the number of documents go round once more.
    picked = F.expr("picks div n + CASE WHEN place - first < picks % n THEN 1 ELSE 0 END")
    chosen = placed.alias("placed").join(plan.alias("plan"), same).select(
        "_row", "source_size", "target", (F.col("passes") + picked).cast("long").alias("copies")
    )
    return rows.join(chosen, "_row").select(*names, "source_size", "target", "copies")


def repeated(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    return mixed.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int"))))
