"""Alignment of the tokens of two tokenizers over the same texts.

Tokenizer A is a byte-level one (a ``tokenizers`` file), B a SentencePiece model. Both sides'
cumulative byte ends go into dictionaries from end to token number; the ends that both have, in
order, cut the two id lists into groups. Within a group no other ends meet, so each of its ends
closes one pair of overlapping tokens: these are its links. How often a pair of ids is linked in
the whole table then tells, for every text, how usual its links are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from sitewatch.llm.arrow import require, slices
from sitewatch.llm.treebpe import byte_characters
from sitewatch.sources.scratch import frozen

BATCH_BYTES = 8 << 20  # text whose links are counted before they are sent
STRETCH = 1 << 19  # characters whose ids are held as lists
SPELLED = 1 << 16  # tokens whose bytes are compared at a time
# The rank library's pattern matcher runs out of stack on longer blanks.
_long_blank = re.compile(r"\s{5000}").search


class Sides:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a: str, b: bytes):
        self.library = Tokenizer.from_str(a)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        to_byte = {ord(c): b for b, c in byte_characters().items()}
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.translate(to_byte).encode("latin-1")
        self.ranked = _ranked(json.loads(a), self.bytes_a)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.pieces.id_to_piece, range(len(self.pieces))))
        ]
        self.size_b = len(self.bytes_b)
        if len(self.bytes_a) * self.size_b >= 1 << 63:
            raise ValueError("too many pairs of ids")
        self.code = np.uint32 if len(self.bytes_a) * self.size_b < 1 << 32 else np.uint64
        self.vocabulary_a, self.vocabulary_b = _vocabulary(self.bytes_a), _vocabulary(self.bytes_b)
        self.sizes_a = np.array(list(map(len, self.bytes_a)))
        self.sizes_b = np.array(list(map(len, self.bytes_b)))
        self.written_a = _written(len(self.bytes_a), ",|")
        self.written_b = _written(self.size_b, ",;")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A of a blank and each text, and by B, which adds the blank, of each text."""
        ours: list = [None] * len(texts)
        left = list(range(len(texts)))
        if self.ranked:
            left = [i for i in left if len(texts[i]) > 4000 and _long_blank(texts[i])]
            rest = set(left)
            for i, t in enumerate(texts):
                if i not in rest:
                    ours[i] = self.ranked.encode_ordinary(" " + t)
        for i in left:
            (found,) = self.library.encode_batch_fast([" " + texts[i]], add_special_tokens=False)
            ours[i] = found.ids
        return ours, self.pieces.encode(texts, num_threads=1)


def _ranked(model: dict, tokens: list[bytes]) -> tiktoken.Encoding | None:
    """The same tokenizer in a faster library, if its ids follow its merges and it has the usual
    pattern; checked here, and by the tests on the ids."""
    split, vocabulary = model["pre_tokenizer"], model["model"]["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
    order = [vocabulary[m] for m in merged]
    usual = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    if model["normalizer"] or not usual or order != sorted(set(order)):
        return None
    ranks = {tokens[i]: i for i in vocabulary.values()}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _written(size: int, signs: str) -> np.ndarray:
    """``[last, id]``: the decimal id with what follows it within and at the end of its group, as
    the eight bytes of a number, zeros behind."""
    if size > 10_000_000:
        raise ValueError("an id of more than seven digits")
    table = np.empty((2, size), np.int64)
    for row, sign in enumerate(signs):
        table[row] = np.array([f"{i}{sign}" for i in range(size)], "S8").view(np.int64)
    return table


def _vocabulary(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and where each token starts."""
    return np.frombuffer(b"".join(tokens), np.uint8), np.append(0, np.cumsum(list(map(len, tokens))))


def _spells(vocabulary: tuple[np.ndarray, np.ndarray], ids: np.ndarray, whole: np.ndarray) -> bool:
    """Whether the bytes of the tokens join to ``whole``; compared some tokens at a time."""
    data, starts = vocabulary
    sizes = starts[ids + 1] - starts[ids]
    if sizes.sum() != len(whole):
        return False
    done = 0
    for first in range(0, len(ids), SPELLED):
        size, start = sizes[first : first + SPELLED], starts[ids[first : first + SPELLED]]
        ends = np.cumsum(size)
        places = np.repeat(start - ends + size, size) + np.arange(ends[-1])
        if not np.array_equal(data[places], whole[done : done + ends[-1]]):
            return False
        done += ends[-1]
    return True


class Aligned:
    """The groups and links of one text: ``cut_a[g]`` tokens of A end with group ``g`` or before."""

    def __init__(self, sides: Sides, a: Sequence[int], b: Sequence[int]):
        self.sides = sides
        self.a, self.b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        ends_a, ends_b = np.cumsum(sides.sizes_a[self.a]), np.cumsum(sides.sizes_b[self.b])
        at_a = dict(zip(ends_a.tolist(), range(1, len(a) + 1)))
        at_b = dict(zip(ends_b.tolist(), range(1, len(b) + 1)))
        common = [e for e in at_a if e in at_b]  # ascending, as the ends went in
        self.cut_a = np.fromiter(map(at_a.__getitem__, common), np.int64, len(common))
        self.cut_b = np.fromiter(map(at_b.__getitem__, common), np.int64, len(common))
        # Every end of A closes a pair with the token of B around it, and every other end of B.
        alone = np.ones(len(b), bool)
        alone[self.cut_b - 1] = False
        self.linked_a = np.append(self.a, self.a[np.searchsorted(ends_a, ends_b[alone])])
        self.linked_b = np.append(self.b[np.searchsorted(ends_b, ends_a)], self.b[alone])

    def codes(self) -> np.ndarray:
        return (self.linked_a * self.sides.size_b + self.linked_b).astype(self.sides.code)

    def written(self) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        last_a, last_b = np.zeros(len(self.a), np.int8), np.zeros(len(self.b), np.int8)
        last_a[self.cut_a - 1], last_b[self.cut_b - 1] = 1, 1
        # Tokens of A stand behind those of B of all groups before, and the other way round.
        group_a = np.repeat(np.append(0, self.cut_b[:-1]), np.diff(self.cut_a, prepend=0))
        group_b = np.repeat(self.cut_a, np.diff(self.cut_b, prepend=0))
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + group_a] = self.sides.written_a[last_a, self.a]
        out[np.arange(len(self.b)) + group_b] = self.sides.written_b[last_b, self.b]
        return out.tobytes().translate(None, b"\0")[:-1]

    def text(self) -> str:
        return self.written().decode()


def aligned(sides: Sides, texts: list[str | None]) -> Iterator[Aligned | None]:
    """None for a text without tokens: null, empty, or not the bytes that either side's tokens join to."""
    found = _tokens(sides, [t for t in texts if t])
    for text in texts:
        if not text:
            yield None
            continue
        a, b = (np.array(ids, np.int64) for ids in next(found))
        whole = np.frombuffer(b" " + text.encode(), np.uint8)
        same = _spells(sides.vocabulary_a, a, whole) and _spells(sides.vocabulary_b, b, whole)
        yield Aligned(sides, a, b) if same else None


def _tokens(sides: Sides, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
    """Ids of each text on both sides, asked for a stretch of texts at a time."""
    start = 0
    while start < len(texts):
        end, held = start + 1, len(texts[start])
        while end < len(texts) and held + len(texts[end]) <= STRETCH:
            held += len(texts[end])
            end += 1
        yield from zip(*sides.encode(texts[start:end]))
        start = end


@lru_cache(maxsize=1)
def _sides(a: str, b: bytes) -> Sides:
    """One for each Python worker, which keeps its tables from task to task."""
    return Sides(a, b)


def _models(df: DataFrame, a_path: str, b_path: str):
    """Both files as a broadcast: of fixed size, so executors need none."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return df.sparkSession.sparkContext.broadcast((f.read(), g.read()))


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Adds ``a_ids``, ``b_ids`` and ``groups``: an array of how many tokens of A and of B end with
    each group or before. A text without tokens (null, empty, or with other bytes than its tokens)
    has empty arrays. Rows are taken as they are; columns of the outputs' names are replaced.
    """
    require(df, text)
    files = _models(df, a_path, b_path)
    df = df.drop("a_ids", "b_ids", "groups")
    group = T.StructType(_fields(T.IntegerType(), "a", "b"))
    added = T.StructType(
        [*_fields(T.ArrayType(T.IntegerType()), "a_ids", "b_ids"), T.StructField("groups", T.ArrayType(group))]
    )
    schema = T.StructType([*df.schema.fields, *added.fields])
    types = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*files.value)
        for batch in batches:
            for part in slices(batch, text):
                found = list(aligned(sides, part.column(text).to_pylist()))
                columns = [
                    [x.a.tolist() if x else [] for x in found],
                    [x.b.tolist() if x else [] for x in found],
                    [[{"a": a, "b": b} for a, b in zip(x.cut_a.tolist(), x.cut_b.tolist())] if x else [] for x in found],
                ]
                new = [pa.array(c, f.type) for c, f in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema.names)

    return df.mapInArrow(run, schema)


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


LONG = T.LongType()
FACTS = [*_fields(LONG, "n_a", "n_b", "n_groups", "n_links"), T.StructField("groups_sha256", T.StringType())]
SCORES = _fields(LONG, "n_best", "count_sum")


def link_scores(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """For each row, without ``text``: the numbers of tokens, groups and links, the hash of the
    written groups, ``n_best``, the links whose pair is the most linked one of its B id in the
    whole table, ties included, and ``count_sum``, the sum of how often each link's pair is linked.

    A text without tokens has zeros and an empty hash; repeated rows count each time. Columns of
    the outputs' names are replaced; the input may have any other names but those in ``_batch``,
    ``_links``, ``_pair``, ``_count`` and ``_best``.

    Links are written once with the rows, a few bytes each. What is counted and asked for over
    all tasks are the different pairs of a batch of texts, so a pair that every text has is one
    row a batch. A text's links are in one row, as the text was.
    """
    require(df, text)
    files = _models(df, a_path, b_path)
    kept = df.drop(text, *(f.name for f in FACTS + SCORES)).schema.fields
    names = [f.name for f in kept]
    own = [T.StructField("_batch", LONG), T.StructField("_links", T.BinaryType())]
    first = T.StructType([*kept, *FACTS, *own])
    fact_types = to_arrow_schema(T.StructType([*FACTS, *own]))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*files.value)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                rows = []
                for x in aligned(sides, part.column(text).to_pylist()):
                    if x is None:
                        rows.append((0, 0, 0, 0, "", number, b""))
                        continue
                    digest = hashlib.sha256(x.written()).hexdigest()
                    codes = x.codes()
                    rows.append((len(x.a), len(x.b), len(x.cut_a), len(codes), digest, number, codes.tobytes()))
                new = [pa.array(c, f.type) for c, f in zip(zip(*rows), fact_types)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new], first.names)
                number += 1

    rows = frozen(df.select(text, *names).mapInArrow(tokens, first))
    size_b, code = (lambda s: (s.size_b, s.code))(_sides(*files.value))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("_batch").to_numpy()
            links = batch.column("_links").to_pylist()
            for number in np.unique(numbers):
                held = b"".join(links[i] for i in np.flatnonzero(numbers == number))
                found, count = np.unique(np.frombuffer(held, code), return_counts=True)
                columns = [np.full(len(found), number), found.astype(np.int64), count]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_batch", "_pair", "_n"])

    asked = rows.select("_batch", "_links").mapInArrow(pairs, "_batch bigint, _pair bigint, _n bigint")
    counts = asked.groupBy("_pair").agg(F.sum("_n").alias("_count"))
    b_id = F.col("_pair") % size_b
    # One row for each id of B: bounded by its vocabulary.
    best = counts.groupBy(b_id.alias("_b")).agg(F.max("_count").alias("_most"))
    marked = counts.join(F.broadcast(best), b_id == F.col("_b")).select(
        "_pair", "_count", (F.col("_count") == F.col("_most")).alias("_best")
    )
    answers = asked.select("_batch", "_pair").join(marked, "_pair")
    result = T.StructType([*kept, *FACTS, *SCORES])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        pair, count, good = (right.column(c).to_numpy() for c in ("_pair", "_count", "_best"))
        order = np.argsort(pair, kind="stable")
        pair, count, good = pair[order], count[order], good[order].astype(np.int64)
        best, total = [], []
        for held in left.column("_links").to_pylist():
            places = np.searchsorted(pair, np.frombuffer(held, code).astype(np.int64))
            best.append(int(good[places].sum()))
            total.append(int(count[places].sum()))
        columns = [left.column(f.name) for f in result.fields[:-2]]
        return pa.table([*columns, pa.array(best, pa.int64()), pa.array(total, pa.int64())], result.names)

    return rows.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInArrow(scored, result)
