"""Near-duplicates by the Jaccard similarity of word shingles, found by SimHash, the rest in bands.

Texts with the same set of shingles are one node. Its SimHash is searched in sharded BK-trees, and
the links found are checked on the shingles. This finds near copies: at similarity 0.8 texts differ in
10 of 64 bits, beyond any radius that shards can serve. So what is not in one component by then
goes on: a node's minimum hashes are cut into bands;
nodes that agree on a band are candidates. At similarity 0.8 two nodes miss each other in all 32
bands of 5 with probability 0.000003, and less above. Every candidate pair is checked on the
shingles themselves before it is linked. Of a band's value, all nodes are first compared with one
of them, unless SimHash has linked the two. Nodes that this leaves in different components are not paired by the band, which texts
with the same boilerplate may share by thousands: they are joined on their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.llm.arrow import require, slices, tidied
from sitewatch.llm.graph import components
from sitewatch.llm import simhash
from sitewatch.llm.simhash import SEED, shingle_hashes
from sitewatch.sources.scratch import frozen

BANDS, ROWS = 32, 5
_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
# Text bytes whose bands are held before they are handed on.
SLICE_BYTES = 1 << 20
# Shingle hashes that all hash functions take at a time.
_TAKEN = 1 << 11
# Shingles handed on at a time.
_SENT = 1 << 16


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted different shingle hashes."""
    return np.unique(shingle_hashes(text or b"", shingle))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed long for each band; a text without words has the same ones as any other."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    low = hashes.astype(np.uint32)
    for i in range(0, len(low), _TAKEN):
        np.minimum(least, (low[i : i + _TAKEN] * _TIMES + _PLUS).min(axis=1), out=least)
    bands = [b.tobytes() for b in least.astype("<u4").reshape(BANDS, ROWS)]
    return [xxhash.xxh64_intdigest(b, i) - (1 << 63) for i, b in enumerate(bands)]


def _sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """``(row, print, fp, keys)`` of rows ``(row, text)``; equal prints are equal sets of shingles.

    ``fp`` is the SimHash of the set, a signed long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                prints, fps, keys = [], [], []
                for t in part.column("text").cast(pa.binary()):
                    found = shingle_set(t.as_py(), shingle)
                    prints.append(xxhash.xxh3_128_digest(found.astype("<u8").tobytes()))
                    fps.append(simhash.majority(found))
                    keys.append(band_keys(found))
                signed = pa.array(np.array(fps, np.uint64).view(np.int64))
                columns = [part.column("row"), pa.array(prints, pa.binary()), signed, pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "print", "fp", "keys"])

    return rows.select("row", "text").mapInArrow(tidied(run), "row long, print binary, fp long, keys array<long>")


def _checked(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose texts have the similarity."""
    left = rows.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = rows.select(F.col("row").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            near = []
            for a, x, b, y in zip(*(batch.column(n) for n in ("a", "text_a", "b", "text_b"))):
                if a != last:
                    last, held = a, shingle_set(x.as_py(), shingle)
                other = shingle_set(y.as_py(), shingle)
                common = len(np.intersect1d(held, other, assume_unique=True))
                near.append(common >= similarity * (len(held) + len(other) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(right, "b").join(left, "a")
    return both.select(
        "a", F.col("text_a").cast("binary").alias("text_a"), "b", F.col("text_b").cast("binary").alias("text_b")
    ).mapInArrow(tidied(run), "a long, b long")


def _shingles(rows: DataFrame, shingle: int) -> DataFrame:
    """``(row, n, shingle)``: the different shingle hashes of each text, and how many it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets = [shingle_set(t.as_py(), shingle) for t in part.column("text").cast(pa.binary())]
                sizes = np.array([len(x) for x in sets])
                rows_of = np.repeat(part.column("row").to_numpy(), sizes)
                columns = [rows_of, np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64)]
                for i in range(0, len(rows_of), _SENT):
                    sent = [pa.array(c[i : i + _SENT]) for c in columns]
                    yield pa.RecordBatch.from_arrays(sent, ["row", "n", "shingle"])

    return rows.select("row", "text").mapInArrow(tidied(run), "row long, n long, shingle long")


def sharing_rare_shingles(rows: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """All pairs ``(a, b)`` of ``rows`` with different ``roots`` that may be similar, and few others.

    Let every text's shingles be in one order, rarest first. Two texts of similarity ``s`` share
    one of the first ``n - ceil(s n) + 1`` of each, ``n`` being the number of its shingles. Such
    a pair meets at its first common shingle, at places ``i`` and ``j`` from 0, and can have at most
    ``min(n - i, m - j)`` in common: a meeting that leaves too few is no candidate. What many
    texts share is at the end of the order, so boilerplate brings nobody together.
    """
    sets = frozen(_shingles(rows, shingle))
    often = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    rarest = Window.partitionBy("row").orderBy("often", "shingle")
    needed = F.ceil(F.col("n") * similarity - 1e-9)
    first = (
        sets.join(often.where("often > 1"), "shingle", "left")
        .select("row", "n", "shingle", F.coalesce("often", F.lit(1)).alias("often"))
        .withColumn("at", F.row_number().over(rarest) - 1)
        .where((F.col("at") <= F.col("n") - needed) & (F.col("often") > 1))
    )
    first = frozen(first.join(roots, "row", "left").select("row", "n", "shingle", "at", F.coalesce("root", "row").alias("root")))
    x = first.select("shingle", F.col("row").alias("a"), F.col("n").alias("n"), F.col("at").alias("i"), F.col("root").alias("p"))
    y = first.select("shingle", F.col("row").alias("b"), F.col("n").alias("m"), F.col("at").alias("j"), F.col("root").alias("q"))
    common = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    enough = common >= similarity * (F.col("n") + F.col("m") - common) - 1e-9
    met = x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & enough)
    return met.select("a", "b").distinct()


def simhash_links(
    nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float, radius: int = 4, blocks: int = 6
) -> tuple[DataFrame, DataFrame]:
    """Candidates ``(a, b)`` by the SimHash of ``nodes`` ``(node, fp)``, and those that are similar.

    The candidates connect all nodes whose fingerprints are within ``radius``; a dense group is not paired.
    """
    prints = frozen(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(prints, "fp").where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.links(prints.select("fp", F.col("first").alias("node")), radius, blocks)
    tried = frozen(same.union(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    return tried, frozen(_checked(tried, rows, shingle, similarity))


def links(
    bands: DataFrame, rows: DataFrame, known: tuple[DataFrame, DataFrame], shingle: int, similarity: float
) -> DataFrame:
    """Links ``(a, b)`` that connect all candidates of ``bands`` ``(row, key)`` that are similar.

    ``known`` has the candidates tried before, and the links found among them, which are returned too.
    """
    before, close = known
    roots = components(close, "a", "b")
    first = bands.groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("z")).where("a < z")
    shared = frozen(bands.join(first.select("key", "a"), "key"))
    tried = shared.where("a < row").select("a", F.col("row").alias("b")).distinct()
    for end in ("a", "b"):
        tried = tried.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    tried = frozen(tried.where(apart).select("a", "b").join(before, ["a", "b"], "left_anti"))
    found = frozen(close.union(_checked(tried, rows, shingle, similarity)))
    roots = components(found, "a", "b").withColumnRenamed("node", "row")
    parted = shared.join(roots, "row", "left").select("key", "row", F.coalesce("root", "row").alias("root"))
    open_keys = parted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s")
    left = frozen(parted.join(open_keys.select("key"), "key").select("row").distinct())
    rest = sharing_rare_shingles(rows.join(left, "row", "left_semi"), roots, shingle, similarity)
    rest = rest.join(tried.union(before), ["a", "b"], "left_anti")
    return found.union(_checked(frozen(rest), rows, shingle, similarity))


def near_duplicates(
    df: DataFrame, shingle: int = 5, similarity: float = 0.8, row: str = "row", text: str = "text"
) -> DataFrame:
    """``(row, component)`` of every row: the smallest row reachable over similar texts.

    ``row`` names a column of different longs. A-Z are lower-cased, words are runs of bytes other
    than blanks and tab to carriage return; a text of fewer words than a shingle is one shingle.
    Rows without words, null texts included, are similar to each other only.
    """
    require(df, row, text)
    rows = df.select(F.col(row).alias("row"), F.col(text).alias("text"))
    sketches = frozen(_sketches(rows, shingle))
    # Sets that are equal have equal keys and fingerprints.
    nodes = sketches.groupBy("print").agg(F.min("row").alias("node"), F.min("fp").alias("fp"))
    nodes = frozen(nodes)
    kept = sketches.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    bands = frozen(kept.select("row", F.explode("keys").alias("key")))
    known = simhash_links(nodes.select("node", "fp"), rows, shingle, similarity)
    roots = components(links(bands, rows, known, shingle, similarity), "a", "b")
    named = nodes.join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("component"))
    return sketches.select("row", "print").join(named, "print").select(F.col("row").alias(row), "component")
