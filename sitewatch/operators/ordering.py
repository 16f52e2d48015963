"""Global positions and running totals without a single-task window.

A window without partitions sends every row to one task. Here the rows are range-sorted over
all tasks and written to the checkpoint folder once, so the partition every row landed in no
longer changes. Then only one small row per partition is needed to know how much came before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.sources.scratch import frozen

# monotonically_increasing_id holds the partition above bit 33 and the row number below it.
_ROW_BITS = 33


def sorted_chunks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` range-sorted and frozen, with ``_chunk`` and the place ``_slot``, both ascending."""
    marked = df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    return frozen(marked).withColumn("_chunk", F.shiftright("_slot", _ROW_BITS))


def _totals_before(chunks: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per partition, the sums of all partitions before it: one row per partition."""
    sums = chunks.groupBy("_chunk").agg(*[t.alias(name) for name, t in totals.items()])
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "_chunk",
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in totals],
    )


def global_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of every row in ``order``, which must leave no ties."""
    chunks = sorted_chunks(df, order)
    before = _totals_before(chunks, {"_before": F.count(F.lit(1))})
    inside = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per partition: bounded by the partition count, not by the data.
    return chunks.join(F.broadcast(before), "_chunk").select(
        *df.columns, (F.col("_before") + inside + 1).alias(name)
    )


def running_totals(df: DataFrame, order: Sequence[Column], totals: Sequence[str]) -> DataFrame:
    """Adds ``<name>_before``: the sum of ``name`` over all rows earlier in ``order``.

    ``order`` must leave no ties. A row's total is what the partitions before its own sum to
    plus what precedes it inside its partition.
    """
    chunks = sorted_chunks(df, order)
    before = _totals_before(chunks, {f"_{t}": F.sum(t) for t in totals})
    inside = (
        Window.partitionBy("_chunk").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    return chunks.join(F.broadcast(before), "_chunk").select(
        *df.columns,
        *[
            (F.coalesce(F.sum(t).over(inside), F.lit(0)) + F.col(f"_{t}")).alias(f"{t}_before")
            for t in totals
        ],
    )
