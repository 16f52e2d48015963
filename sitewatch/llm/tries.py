"""Interaction of document filters, with exact copies found in radix tries.

Five filters, ``A`` to ``E``, are applied to every text: too few words, too few different words,
too many capitals, a forbidden sign, and the text of a smaller key once more. The first four look
at one text. For the last, texts are dealt to tasks by ranges of their beginnings, as long as
needed to part them, and every task inserts its texts into a compressed trie whose terminals hold
the smallest key. What a document fails is a mask of five bits; masks are counted, and all orders
of the filters are read off the counts.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewatch.llm.arrow import require, slices, text_bytes

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
RANGE_BYTES = 16 << 20  # text of a range; beginnings that more of it shares are told further apart
FIRST, LONGER = 8, 16  # characters of the shortest beginnings, and how much longer the next are
DRAWS = 16  # beginnings drawn for each range to find its borders
SLICE_BYTES = 8 << 20  # text in which copies are merged before they are sent


@dataclass(frozen=True)
class Limits:
    """A text fails A with fewer words, B with a smaller percentage of different ones, C with a
    larger percentage of capitals, D with any of the signs."""

    words: int = 100
    distinct: int = 80
    capitals: int = 10
    signs: str = "#$%&*|"


class Node:
    __slots__ = ("edges", "key", "held")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.key = None  # smallest key of the texts that end here
        self.held: list = []  # what came with that key


class RadixTrie:
    """Whole texts; runs of bytes without a branch are one edge."""

    def __init__(self) -> None:
        self.root = Node()

    def terminal(self, text: bytes) -> Node:
        """The node where ``text`` ends, made if it is new."""
        node, at, size = self.root, 0, len(text)
        while at < size:
            edge = node.edges.get(text[at])
            if edge is None:
                end = Node()
                node.edges[text[at]] = (text[at:], end)
                return end
            label, child = edge
            if not text.startswith(label, at):
                same = _shared(label, text, at)
                fork = Node()
                fork.edges[label[same]] = (label[same:], child)
                node.edges[text[at]] = (label[:same], fork)
                label, child = label[:same], fork
            node, at = child, at + len(label)
        return node

    def insert(self, text: bytes, key, item) -> list:
        """Puts ``item`` at the text's end; gives back the items a smaller key makes copies."""
        node = self.terminal(text)
        if node.key is None or key < node.key:
            copies, node.key, node.held = node.held, key, [item]
            return copies
        if key == node.key:
            node.held.append(item)
            return []
        return [item]

    def firsts(self) -> Iterator[list]:
        """The items at every terminal, in the order of no importance."""
        left = [self.root]
        while left:
            node = left.pop()
            if node.held:
                yield node.held
            left += [child for _, child in node.edges.values()]


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of ``label`` and ``text`` from ``at`` on; they differ."""
    low, high = 1, min(len(label), len(text) - at)
    if text.startswith(label[:high], at):
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle
    return low


def masks(column: pa.Array, limits: Limits = Limits()) -> np.ndarray:
    """Bits of A to D that each text fails; null is empty."""
    data, starts = text_bytes(column)

    def per_text(table: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(table[data], dtype=np.int64))[starts])

    kinds = np.zeros((3, 256), np.int8)
    kinds[0, ord("A") : ord("Z") + 1] = 1
    kinds[1, [ord(c) for c in limits.signs]] = 1
    kinds[2] = (np.arange(256) & 0xC0) != 0x80  # first bytes of characters
    capitals, signs, points = map(per_text, kinds)
    words, different = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    held, ends = data.tobytes(), starts.tolist()
    for i in range(len(column)):
        found = held[ends[i] : ends[i + 1]].split()
        words[i], different[i] = len(found), len(set(found))
    fails = (
        words < limits.words,
        100 * different < limits.distinct * words,
        100 * capitals > limits.capitals * points,
        signs > 0,
    )
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _beginnings(texts: Column, heavy: list[list[str]]) -> Column:
    """The shortest beginning that is not among the heavy ones of its length."""
    size, out = FIRST, None
    for shared in heavy:
        start = F.substring(texts, 1, size)
        here = ~start.isin(shared)
        out = F.when(here, start) if out is None else out.when(here, start)
        size *= LONGER
    start = F.substring(texts, 1, size)
    return start if out is None else out.otherwise(start)


def heavy_beginnings(docs: DataFrame, text: str, most: int) -> tuple[list[list[str]], int]:
    """For each length the beginnings that over ``most`` bytes of different texts share, until
    none are left, and all bytes. At most ``bytes / most`` beginnings of a length reach the driver.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = texts.agg(F.sum(F.octet_length("t") + F.lit(8).cast("long"))).first()[0] or 0
    heavy: list[list[str]] = []
    size, left = FIRST, texts
    while total > most:
        start = F.substring("t", 1, size)
        found = (
            left.groupBy(start.alias("start"))
            .agg(
                F.sum(F.octet_length("t") + F.lit(8).cast("long")).alias("n"),
                (F.min(F.xxhash64("t")) != F.max(F.xxhash64("t"))).alias("several"),
            )
            .where((F.col("n") > most) & F.col("several"))
            .select("start")
        )
        shared = [r[0] for r in found.collect()]
        if not shared:
            break
        heavy.append(shared)
        left, size = left.where(start.isin(shared)), size * LONGER
    return heavy, total


def _borders(docs: DataFrame, text: str, heavy: list[list[str]], total: int, most: int) -> list[str]:
    """Beginnings that cut the texts into ranges, from texts drawn by a hash of theirs.

    They only balance the tasks. The draw grows with the number of ranges, a beginning each.
    """
    ranges = -(-2 * total // most)
    if ranges <= 1:
        return []
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    share = ranges * DRAWS * 2.0**32 / total  # of 2 ** 32, for each byte
    drawn = texts.where(
        F.pmod(F.xxhash64("t"), F.lit(1 << 32)) < F.least(share * (F.octet_length("t") + 8), F.lit(2.0**32))
    ).select(_beginnings(F.col("t"), heavy).alias("start"))
    counted = sorted((r["start"], r["count"]) for r in drawn.groupBy("start").count().collect())
    borders, seen, due = [], 0, DRAWS
    for start, _ in counted:
        # Copies of a text are one row of a task, so each beginning counts once.
        seen += 1
        if seen >= due and start != counted[0][0]:
            borders.append(start)
            due = seen + DRAWS
    return borders


def failures(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    limits: Limits = Limits(),
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``(key, part, mask)`` for every row: bit 0 for A up to bit 4 for E.

    E marks a text that a smaller key has too, anywhere in the table. Null and empty texts are
    equal, a null part is the empty string. A row without a key is no copy and makes none; rows
    of the same key do not make copies of each other. Texts of any length are compared whole.
    Other columns are ignored, whatever their names.

    Copies within a batch travel as one text, so a text that a third of all rows hold is sent
    once a batch, and its terminal keeps the documents of the smallest key only: what a smaller
    key displaces leaves the task at once.
    """
    require(docs, key, text, part)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(part).alias("part"))
    heavy, total = heavy_beginnings(docs, "text", range_bytes)
    borders = _borders(docs, "text", heavy, total, range_bytes)
    shared = [frozenset(h) for h in heavy]
    kind = docs.schema["key"].dataType
    member = T.StructType([T.StructField("key", kind), T.StructField("part", T.StringType())])
    sent = T.StructType(
        [
            T.StructField("range", T.IntegerType()),
            T.StructField("text", T.BinaryType()),
            T.StructField("mask", T.IntegerType()),
            T.StructField("docs", T.ArrayType(member)),
        ]
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                mask = masks(piece.column("text"), limits).tolist()
                texts = piece.column("text").to_pylist()
                keys, parts = piece.column("key").to_pylist(), piece.column("part").to_pylist()
                places: dict[str, int] = {}
                rows: list[tuple[int, bytes, int]] = []
                members: list[list[dict]] = []
                for t, m, k, p in zip(texts, mask, keys, parts):
                    t = t or ""
                    at = places.setdefault(t, len(rows))
                    if at == len(rows):
                        size, start = FIRST, t[:FIRST]
                        for some in shared:
                            if start not in some:
                                break
                            size *= LONGER
                            start = t[:size]
                        rows.append((bisect_right(borders, start), t.encode(), m))
                        members.append([])
                    members[at].append({"key": k, "part": p or ""})
                out = [*map(list, zip(*rows)), members] if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(out, arrow_sent)], schema=arrow_sent
                )

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = RadixTrie(), []

        def rows(everything: bool) -> Iterator[pa.RecordBatch]:
            if out and (everything or len(out) >= 20_000):
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), arrow_out)]
                out.clear()
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_out)

        for batch in batches:
            texts, marks, docs = (batch.column(c).to_pylist() for c in ("text", "mask", "docs"))
            for t, m, members in zip(texts, marks, docs):
                for d in members:
                    k, p = d["key"], d["part"]
                    if k is None:
                        out.append((k, p, m))
                    else:
                        out += [(k, p, m | COPY) for k, p, m in trie.insert(t, k, (k, p, m))]
                yield from rows(False)
        for held in trie.firsts():
            out += held
            yield from rows(False)
        yield from rows(True)

    result = T.StructType([*member.fields, T.StructField("mask", T.IntegerType())])
    arrow_sent, arrow_out = _arrow(sent), _arrow(result)
    dealt = docs.mapInArrow(measured, sent)
    if borders:
        dealt = dealt.repartitionById(len(borders) + 1, F.col("range"))
    else:
        dealt = dealt.coalesce(1)
    return dealt.mapInArrow(flagged, result).select(
        F.col("key").alias(key), F.col("part").alias("part"), "mask"
    )


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def audit(failed: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each part, order of the filters and step, how many documents the step's filter
    removes, finds removed already, fails alone, and how many remain.

    ``failed`` comes from ``failures``; ``labels`` has ``quality`` and ``toxic`` of some keys. A
    key with several labels is good, or toxic, if any of them says so. Every part has all 600
    rows, zeros included; an empty table has none. ``shapley`` is what a filter removes, summed
    over all orders.
    """
    require(labels, key, "quality", "toxic")
    known = labels.groupBy(key).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad")
    )
    # Repeated rows, and all without a key, are merged before the join.
    merged = failed.groupBy(key, "part", "mask").agg(F.count(F.lit(1)).alias("n"))

    def where(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))

    counted = (
        merged.join(known, key, "left")
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), where("good").alias("good"), where("bad").alias("bad"))
    )
    steps = [
        ("".join(order), i + 1, 1 << LETTERS.index(order[i]), sum(1 << LETTERS.index(c) for c in order[:i]))
        for order in permutations(LETTERS)
        for i in range(len(order))
    ]
    names = ("filter_order", "step", "own", "before")
    plan = F.arrays_zip(*[F.lit(list(c)).alias(n) for n, c in zip(names, zip(*steps))])
    rows = counted.select("*", F.explode(plan).alias("s")).select(
        "part", "mask", "n", "good", "bad", *[F.col("s")[n].alias(n) for n in names]
    )
    mask, own, before = F.col("mask"), F.col("own"), F.col("before")
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0

    def total(condition: Column, value: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    table = rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == own).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "bad").alias("toxic_lost"),
    )
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    worth = table.groupBy("part", letter.alias("_letter")).agg(F.sum("removed").alias("shapley"))
    return (
        table.withColumn("_letter", letter)
        .join(worth, ["part", "_letter"])
        .drop("_letter")
        .withColumn("step", F.col("step").cast("int"))
    )
