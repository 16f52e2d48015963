"""Near-duplicates by SimHash fingerprints, searched in sharded BK-trees.

Fingerprints are cut into blocks. Two that differ in at most ``radius`` bits agree on
``blocks - radius`` blocks, so every choice of that many blocks, with their value, names a shard,
and all close pairs meet in one. Each shard's different fingerprints form a BK-tree. A shard of
more than ``tree_size`` fingerprints becomes several trees of bounded size; each of them then
receives all fingerprints of the shard as queries, in batches. Links found in a tree are reduced
to one per fingerprint before they leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewatch.llm.arrow import require
from sitewatch.llm.graph import components
from sitewatch.sources.scratch import frozen

BITS = 64
SEED = 42
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)
# Shingle hashes whose bits are counted at a time.
_COUNTED = 1 << 14


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the shingles of ``text``, repeats included; none without words."""
    words = text.translate(_FOLD).split()
    if not words:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero without any."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _COUNTED):
        part = hashes[i : i + _COUNTED].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the shingles of ``text``, repeats included; zero without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(
    df: DataFrame, shingle: int = 4, text: str = "text", name: str = "fp"
) -> DataFrame:
    """Replaces ``text`` by its fingerprint, a signed long; a null text is one without words.

    A-Z are lower-cased, words are runs of bytes other than blanks and tab to carriage return.
    """
    require(df, text)
    kept = [c for c in df.columns if c not in (text, name)]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            prints = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], np.uint64)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints.view(np.int64))], [*kept, name])

    return df.select(*kept, text).mapInArrow(run, schema)


class BKTree:
    """Different fingerprints; a node's children are keyed by their distance to it."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in range(len(values))]
        rest = [(np.arange(len(values)), -1, 0)] if len(values) else []
        while rest:
            inside, parent, distance = rest.pop()
            node, inside = int(inside[0]), inside[1:]
            if parent >= 0:
                self.children[parent][distance] = node
            apart = np.bitwise_count(values[inside] ^ values[node])
            rest += [(inside[apart == d], node, int(d)) for d in np.unique(apart)]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each node with the positions of the queries within ``radius`` of it.

        All queries go down together; an edge is followed by those it can still lead to a hit.
        """
        rest = [(0, np.arange(len(queries)))] if len(self.values) else []
        while rest:
            node, at = rest.pop()
            apart = np.bitwise_count(queries[at] ^ self.values[node]).astype(np.int16)
            if len(hits := at[apart <= radius]):
                yield node, hits
            for distance, child in self.children[node].items():
                if len(on := at[np.abs(apart - distance) <= radius]):
                    rest.append((child, on))


class _Forest:
    """Union-find over positions, merging a star at a time."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while (self.parent[up] != up).any():
            up = self.parent[up]
        return up

    def merge(self, at: np.ndarray) -> None:
        tops = np.unique(self.roots(at))
        self.parent[tops] = tops[0]


class _Shard:
    """One tree, and the links its queries have to it: at most one for each row."""

    def __init__(self, values: np.ndarray, ids: np.ndarray, radius: int):
        self.tree, self.ids, self.radius = BKTree(values), ids, radius
        self.forest = _Forest(len(values))
        for node, hits in self.tree.search(values, radius):
            self.forest.merge(np.append(hits, node))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        top = self.forest.roots(np.arange(len(self.ids)))
        off = np.flatnonzero(top != np.arange(len(top)))
        return self.ids[off], self.ids[top[off]]

    def query(self, values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of other fingerprints of the shard; those that join two parts join the parts."""
        size = len(self.ids)
        both = _Forest(size + len(values))
        both.parent[:size] = self.forest.parent
        for node, hits in self.tree.search(values, self.radius):
            both.merge(np.append(hits + size, node))
        self.forest.parent[:] = both.roots(np.arange(size))
        top = both.roots(np.arange(size, size + len(values)))
        off = np.flatnonzero(top < size)
        return ids[off], self.ids[top[off]]


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """Lowest bit and number of bits of each block."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """Array of the shards of a fingerprint: the number of the choice, and the chosen blocks."""
    layout, keys = _blocks(blocks), []
    for number, chosen in enumerate(combinations(layout, blocks - radius)):
        value, shift = F.lit(number).cast("long"), 0
        for low, width in chosen:
            part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
            value = F.shiftleft(value, width).bitwiseOR(part)
            shift += width
        if shift + number.bit_length() > 63:
            raise ValueError("choose fewer blocks: the shard keys do not fit a long")
        keys.append(value)
    return F.array(*keys)


def _search(rows: DataFrame, radius: int) -> DataFrame:
    """Links of sorted rows ``(key, part, queried, fp, node)``; a shard's own rows come first."""
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "part", "queried", "fp", "node")
        held: list[tuple[np.ndarray, ...]] = []  # own rows of the shard being read
        state: dict = {"key": None, "shard": None}
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> None:
            if state["shard"] is None and held:
                values, nodes = (np.concatenate(x) for x in zip(*held))
                if len(values) > 1:
                    state["shard"] = _Shard(values, nodes, radius)
            if state["shard"] is not None:
                out.append(state["shard"].links())
            held.clear()
            state["shard"] = None

        for batch in batches:
            key, part, queried, fp, node = (batch.column(n).to_numpy(zero_copy_only=False) for n in names)
            fp = fp.view(np.uint64)
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            starts, ends = np.append(0, cut), np.append(cut, len(key))
            # A shard of one row within the batch has no links.
            busy = (ends - starts > 1) | (starts == 0) | (ends == len(key))
            for s, e in zip(starts[busy].tolist(), ends[busy].tolist()):
                if state["key"] != (key[s], part[s]):
                    close()
                    state["key"] = (key[s], part[s])
                own = s + int(np.searchsorted(queried[s:e], True))
                if own > s:
                    held.append((fp[s:own], node[s:own]))
                if own < e:
                    if state["shard"] is None:
                        values, nodes = (np.concatenate(x) for x in zip(*held))
                        state["shard"] = _Shard(values, nodes, radius)
                    out.append(state["shard"].query(fp[own:e], node[own:e]))
            if sum(len(a) for a, _ in out) > 10_000:
                yield _pairs(out)
        close()
        if out:
            yield _pairs(out)

    return rows.mapInArrow(run, schema)


def _pairs(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (pa.array(np.concatenate(x)) for x in zip(*out))
    out.clear()
    return pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def links(
    nodes: DataFrame, radius: int = 4, blocks: int = 6, tree_size: int = 4096
) -> DataFrame:
    """Links ``(a, b)`` between nodes that connect all whose fingerprints are within ``radius``.

    ``nodes`` has one row ``(fp, node)`` for each different fingerprint. The links connect the
    same nodes as all close pairs would, without listing all pairs of a dense group.
    """
    if not radius < blocks:
        raise ValueError("blocks must exceed the radius")
    rows = nodes.select("fp", "node", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > tree_size).select(
        "key", F.ceil(F.col("n") / tree_size).cast("int").alias("parts")
    )
    parts = F.coalesce("parts", F.lit(1))
    # Each fingerprint belongs to one tree of its shard and is a query to the others.
    rows = (
        rows.join(large, "key", "left")
        .withColumn("own", F.pmod(F.xxhash64("fp"), parts).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("key", "part", (F.col("part") != F.col("own")).alias("queried"), "fp", "node")
    )
    number = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(number, "key", "part")
    return _search(dealt.sortWithinPartitions("key", "part", "queried"), radius)


def near_duplicates(
    df: DataFrame,
    shingle: int = 4,
    radius: int = 4,
    blocks: int = 6,
    tree_size: int = 4096,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, fp, component)`` of every row: the smallest key reachable over close fingerprints.

    Rows without a key get the component of their fingerprint, but never name one; a component
    without any key is null. Repeated rows come back as often. Rows without words have the
    fingerprint zero and are linked like any others.
    """
    require(df, key, text)
    prints = frozen(fingerprints(df.select(F.col(key).alias("key"), text), shingle, text))
    nodes = frozen(prints.groupBy("fp").agg(F.min("key").alias("node")))
    roots = components(links(nodes.where("node IS NOT NULL"), radius, blocks, tree_size), "a", "b")
    named = nodes.join(roots, "node", "left").select(
        "fp", F.coalesce("root", "node").alias("component")
    )
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component")
