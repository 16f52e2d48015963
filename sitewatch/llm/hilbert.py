"""Shards along a Hilbert curve over several metadata columns.

Each column is quantised by its quantiles, the cells are visited along the curve, and the curve
is cut into runs of equal numbers of rows. Neighbours on the curve are close in every column, so
the range of each column in a shard is narrow and files can be skipped by any of them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewatch.llm.arrow import require
from sitewatch.operators.ordering import global_position, running_totals


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of points ``cells[i]``, each coordinate of ``bits`` bits.

    From the highest bit down, the quadrant a point lies in says how the curve runs through it:
    the lower bits of the coordinates are mirrored or exchanged accordingly. What remains is a
    Gray code of the distance, its bits dealt to the coordinates in turn.
    """
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for axis in x:
            upper = (axis & bit) != 0
            swap = np.where(upper, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(upper, below, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            out = out << 1 | (axis >> level & 1)
    return out


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType))


def _place(df: DataFrame, column: str) -> Column:
    """What orders the column's values: a double, or a string of any length."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    if _is_number(kind):
        return F.col(column).cast("timestamp").cast("double")
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    return F.col(column).cast("string")


def _string_cells(places: DataFrame, bits: int) -> dict[str, tuple[list[bytes], list[int]]]:
    """For each string column, where its cells begin: the first value of each, and its number.

    Different values are counted before they are sorted over all tasks; a value lies in the cell
    of the share of rows before it. At most ``2**bits`` values a column reach the driver.
    """
    if not places.columns:
        return {}
    counts = (
        places.unpivot([], places.columns, "dimension", "value")
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = running_totals(counts, [F.col("dimension"), F.col("value")], ["n"])
    spans = counts.groupBy("dimension").agg(F.min("n_before").alias("first"), F.sum("n").alias("total"))
    cell = F.floor((F.col("n_before") - F.col("first")) * (1 << bits) / F.col("total")).cast("int")
    begins = (
        counts.join(F.broadcast(spans), "dimension")  # one row a dimension
        .groupBy("dimension", cell.alias("cell"))
        .agg(F.min("value").alias("value"))
    )
    found: dict[str, tuple[list[bytes], list[int]]] = {c: ([], []) for c in places.columns}
    for row in sorted(begins.collect(), key=lambda r: (r["dimension"], r["cell"])):
        found[row["dimension"]][0].append(row["value"].encode())
        found[row["dimension"]][1].append(row["cell"])
    return found


def along_curve(
    df: DataFrame, dimensions: Sequence[str], name: str = "curve", bits: int = 6, error: float = 1e-3
) -> DataFrame:
    """Adds each row's distance along the curve through its ``dimensions``.

    A dimension of numbers or times is cut at up to ``2**bits - 1`` different quantiles
    (approximate, a sketch of bounded size on the driver). Any other goes by its value as a
    string, whole, in the order of its bytes, and by the exact number of rows with smaller ones.
    A null lies in the lowest cell. Any column can be a dimension.
    """
    require(df, *dimensions)
    if not dimensions or bits * len(dimensions) > 62:
        raise ValueError("give at least one dimension and at most 62 bits in all")
    places = df.select(*[_place(df, c).alias(f"p{i}") for i, c in enumerate(dimensions)])
    numbers = [f"p{i}" for i, c in enumerate(dimensions) if _is_number(df.schema[c].dataType)]
    wanted = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = places.approxQuantile(numbers, wanted, error) if numbers else []
    cuts = {c: np.unique(np.array(x, np.float64)) for c, x in zip(numbers, found)}
    begins = _string_cells(places.drop(*numbers), bits)

    def cells(i: int, values: pd.Series) -> np.ndarray:
        place = f"p{i}"
        if place in cuts:
            v = values.to_numpy(np.float64)
            return np.where(np.isnan(v), 0, np.searchsorted(cuts[place], v, "right"))
        codes, different = pd.factorize(values)
        first, numbered = begins[place]
        at = [numbered[bisect_right(first, x.encode()) - 1] for x in different]
        return np.array([*at, 0])[codes]  # a null has code -1

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack([cells(i, c) for i, c in enumerate(columns)], axis=1), bits))

    return df.withColumn(name, curve(*[_place(df, c) for c in dimensions]))


def shards(
    df: DataFrame,
    dimensions: Sequence[str],
    ties: Sequence[str],
    count: int = 24,
    bits: int = 6,
) -> DataFrame:
    """Adds ``shard`` (0 to ``count - 1``) and ``slot`` (from 0 within the shard).

    Rows are ordered by the curve, then by ``ties``, and cut into ``count`` runs whose numbers of
    rows differ by one at most. The order comes from a range sort over all tasks: a cell of any
    size is spread by the ties, and equal rows after them may be exchanged. Columns called
    ``shard`` or ``slot`` are replaced.
    """
    require(df, *ties)
    names = [c for c in df.columns if c not in ("shard", "slot")]
    marked = along_curve(df.select(*names), dimensions, "_curve", bits)
    marked = marked.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("_curve"), *[F.col(c) for c in ties], F.col("_row")]
    placed = global_position(marked, order, "_place")
    total = placed.agg(F.count(F.lit(1)).alias("_total"))
    at, n = F.col("_place") - 1, F.col("_total")
    shard = F.expr(f"(_place - 1) * {count} div _total")
    first = F.expr(f"(shard * _total + {count - 1}) div {count}")
    return (
        placed.join(F.broadcast(total))  # one row
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", (at - first).cast("long"))
        .select(*names, "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order; statistics of the files then prune reads."""
    count = sharded.agg(F.max("shard")).first()[0]
    parts = 1 if count is None else count + 1
    (
        sharded.repartitionByRange(parts, "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
