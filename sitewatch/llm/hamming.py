"""Exact nearest binary codes by incremental multi-index hashing.

Codes are cut into segments, and every segment has an index of its own. Round r looks up, for
each unfinished query and each segment, the segment values that differ in exactly r bits. A code
not met after round r differs by more than r bits in every segment, so by at least
``segments * (r + 1)`` in all: once a query's k-th verified distance is below that, its answer
is proven and it leaves. Until then its k-th distance bounds what a lookup lets through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewatch.llm.arrow import require
from sitewatch.sources.scratch import frozen

SEGMENT_BITS = 16


def sign_codes(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``(key, code)``: bit i of the code is set where component i is positive.

    Codes are arrays of longs, 64 bits each. Vectors that are null or of another length than
    ``dims`` have no code and are left out; a null or NaN component is not positive.
    """
    require(df, key, vector)
    words = []
    for start in range(0, dims, 64):
        bits = [
            F.when(
                (F.col(vector)[i] > 0) & ~F.isnan(F.col(vector)[i]), F.lit(_signed(1 << (i - start)))
            ).otherwise(F.lit(0))
            for i in range(start, min(start + 64, dims))
        ]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits]))
    return df.where(F.size(vector) == dims).select(F.col(key).alias("key"), F.array(*words).alias("code"))


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def _segment(code: Column, number: int) -> Column:
    word, shift = divmod(number * SEGMENT_BITS, 64)
    return F.shiftrightunsigned(code[word], shift).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")


def _least(df: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """``(by, best)``: the k smallest of ``order`` for each value of ``by``, as an array.

    Every task first keeps the k smallest of what it has, so no more than k rows of a value
    leave a task, however frequent it is.
    """
    schema = df.select(by, *order).schema
    item = T.StructType([schema[c] for c in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            kept = part if kept is None else pa.concat_tables([kept, part])
            if kept.num_rows > 50_000:
                kept = _trim(kept, by, order, k)
                if kept.num_rows > 25_000:  # many values: pass them on
                    yield from kept.to_batches()
                    kept = None
        if kept is not None and kept.num_rows:
            yield from _trim(kept, by, order, k).to_batches()

    trimmed = df.select(by, *order).mapInArrow(run, schema)
    best = F.slice(F.array_sort(F.collect_list(F.struct(*order))), 1, k)
    return trimmed.groupBy(by).agg(best.cast(T.ArrayType(item)).alias("best"))


def _trim(rows: pa.Table, by: str, order: list[str], k: int) -> pa.Table:
    groups = rows.column(by).combine_chunks()
    number = groups.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    keys = [rows.column(c).to_numpy() for c in reversed(order)]
    at = np.lexsort([*keys, number])
    number = number[at]
    first = np.maximum.accumulate(np.where(np.append(True, number[1:] != number[:-1]), np.arange(len(at)), 0))
    return rows.take(at[np.arange(len(at)) - first < k])


def _probes(queries: DataFrame, segments: int, radius: int) -> DataFrame:
    """Rows ``(query, q, most)`` with ``(segment, value)`` for all values at ``radius`` bits."""
    masks = np.array(
        [sum(1 << b for b in bits) for bits in combinations(range(SEGMENT_BITS), radius)], np.int32
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(batch.num_rows):
                row = batch.slice(start, 1)
                values = row.column("segments")[0].values.to_numpy(zero_copy_only=False)
                found = (values[:, None] ^ masks[None, :]).ravel()
                numbers = np.repeat(np.arange(segments, dtype=np.int32), len(masks))
                same = pa.array(np.zeros(len(found), np.int32))
                own = [row.column(c).take(same) for c in ("query", "q", "most")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(numbers), pa.array(found)],
                    ["query", "q", "most", "segment", "value"],
                )

    parts = F.array(*[_segment(F.col("q"), i) for i in range(segments)])
    return queries.select("query", "q", "most", parts.alias("segments")).mapInArrow(
        run, "query long, q array<long>, most int, segment int, value int"
    )


def nearest(codes: DataFrame, queries: DataFrame, k: int, bits: int) -> DataFrame:
    """``(query, rank, key, distance)``: the k nearest of ``codes`` to each query, exactly.

    Both sides are ``(key, code)`` with ``bits`` bits, a multiple of the segment width. Ties go
    to the smaller key; a query finds its own row if it is among the codes. With fewer than k
    codes all of them are returned. Equal codes are one entry of the index, with its k smallest
    keys: more of them can never be among the k nearest. A repeated row counts once; a key with
    several codes is a neighbour at its distance with each, and as a query takes the least code.
    """
    if bits % SEGMENT_BITS:
        raise ValueError(f"codes need a multiple of {SEGMENT_BITS} bits")
    segments = bits // SEGMENT_BITS
    text = F.concat_ws(",", F.col("code").cast("array<string>"))
    numbered = codes.where("key IS NOT NULL").withColumn("id", text)
    index = frozen(
        _least(numbered.select("id", "key").distinct(), "id", ["key"], k).select(
            F.split("id", ",").cast("array<long>").alias("code"), F.col("best.key").alias("keys")
        )
    )
    tables = index.select(
        "code", "keys",
        F.posexplode(F.array(*[_segment(F.col("code"), i) for i in range(segments)])).alias("segment", "value"),
    )
    left = frozen(
        queries.where("key IS NOT NULL")
        .groupBy(F.col("key").alias("query"))
        .agg(F.min("code").alias("q"), F.lit(bits).alias("most"))
    )
    words = bits // 64 + (bits % 64 > 0)
    apart = reduce(add, [F.bit_count(F.col("code")[w].bitwiseXOR(F.col("q")[w])) for w in range(words)])
    best, done = None, []
    for radius in range(SEGMENT_BITS + 1):
        # Of a size that Spark cannot foresee, so never a broadcast.
        probes = _probes(left, segments, radius).hint("merge").alias("p")
        same = (F.col("p.segment") == F.col("t.segment")) & (F.col("p.value") == F.col("t.value"))
        met = probes.join(tables.alias("t"), same & (apart <= F.col("most"))).select(
            "query", apart.cast("int").alias("distance"), F.explode("keys").alias("key")
        )
        if best is not None:
            met = met.union(best.select("query", F.explode("best").alias("b")).select("query", "b.*"))
        # A code met in several segments is the same row.
        best = frozen(_least(met.distinct(), "query", ["distance", "key"], k))
        proven = (F.size("best") >= k) & (F.col("best")[k - 1]["distance"] < segments * (radius + 1))
        if radius == SEGMENT_BITS:
            proven = F.lit(True)
        done.append(best.where(proven))
        best = best.where(~proven)
        # The k-th distance so far, where there are k: farther codes cannot be among the nearest.
        kth = best.select("query", F.get("best", F.lit(k - 1))["distance"].alias("kth"))
        left = frozen(
            left.join(done[-1], "query", "left_anti")
            .join(kth, "query", "left")
            .select("query", "q", F.coalesce("kth", F.lit(bits)).alias("most"))
        )
        if left.isEmpty():
            break
    found = reduce(DataFrame.union, done)
    return found.select("query", F.posexplode("best").alias("rank", "b")).select(
        "query", (F.col("rank") + 1).alias("rank"), "b.key", "b.distance"
    )
