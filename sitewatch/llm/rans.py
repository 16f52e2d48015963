"""Token ids in files of interleaved range asymmetric numeral systems.

A file has one frequency table, counted over all of its ids, that its blocks share. A block holds
65,536 consecutive ids dealt to 64 lanes, which write one stream of 32-bit words. At every
checkpoint the block keeps the lanes' states and the place in the stream, so blocks, and the
parts between checkpoints, are decoded independently: here all at once, as rows of numpy arrays.
Tables, document lists and blocks carry checksums, and each part must end in the state that the
next checkpoint names.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitewatch.llm.arrow import require, slices
from sitewatch.llm.files import opened, written
from sitewatch.llm.treebpe import byte_characters
from sitewatch.sources.scratch import frozen

MAGIC = b"IDSRANS1"
LANES, STEPS, PART = 64, 1024, 256  # lanes; ids of a lane in a block, and between checkpoints
LOW = 1 << 31  # states lie in [LOW, LOW << 32)
FILE_IDS = 1 << 22  # ids after which a task starts another file
WORDS = 1_200_000  # different words whose ids a worker keeps
DENSE = 1 << 22  # ids below have a table of places


@dataclass(frozen=True)
class Table:
    """Symbols in ascending order, with frequencies that sum to ``1 << bits``."""

    symbols: np.ndarray
    counts: np.ndarray
    bits: int

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        symbols, counts = np.unique(ids, return_counts=True)
        bits = max(16, len(symbols).bit_length() + 2)
        if bits > 28:
            raise ValueError("too many different ids for one file")
        size = 1 << bits
        # Every symbol gets one slot and its share of the others, rounded down.
        shares = counts * (size - len(symbols)) // counts.sum() + 1
        shares[np.argmax(counts)] += size - shares.sum()
        return cls(symbols.astype(np.uint32), shares.astype(np.uint64), bits)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def _encode_blocks(ids: np.ndarray, table: Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``ids[block, step, lane]`` as positions in the table; for each block its checkpoint
    states, their places in the stream, and the stream."""
    blocks, steps, lanes = ids.shape
    counts, starts, bits = table.counts, table.starts, np.uint64(table.bits)
    low = np.uint64(LOW >> table.bits << 32)
    state = np.full((blocks, lanes), LOW, np.uint64)
    words = np.zeros((steps, blocks, lanes), np.uint32)
    emits = np.zeros((steps, blocks, lanes), bool)
    marks = list(range(0, steps, PART))
    states = np.zeros((len(marks), blocks, lanes), np.uint64)
    for step in range(steps - 1, -1, -1):
        count, start = counts[ids[:, step]], starts[ids[:, step]]
        full = state >= low * count
        words[step], emits[step] = state, full  # the low 32 bits
        state = np.where(full, state >> np.uint64(32), state)
        whole = state // count
        state = (whole << bits) + (state - whole * count) + start
        if step % PART == 0:
            states[step // PART] = state
    for b in range(blocks):
        sent = emits[:, b].sum(axis=1)
        places = np.append(0, np.cumsum(sent))[marks]
        yield states[:, b], places.astype(np.uint32), words[:, b][emits[:, b]]


def _decode_parts(
    states: np.ndarray, places: np.ndarray, stream: np.ndarray, steps: int, table: Table
) -> tuple[np.ndarray, np.ndarray]:
    """``steps`` ids of each lane of each part, as positions in the table, and the last states."""
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    slots = np.repeat(np.arange(len(table.counts), dtype=np.uint32), table.counts.astype(np.int64))
    counts, starts = table.counts, table.starts
    state, at = states.copy(), places.astype(np.int64)
    stream = np.append(stream, np.uint32(0)).astype(np.uint64)
    out = np.empty((len(state), steps, state.shape[1]), np.uint32)
    for step in range(steps):
        slot = state & mask
        symbol = slots[slot]
        out[:, step] = symbol
        state = counts[symbol] * (state >> bits) + slot - starts[symbol]
        need = state < LOW
        order = np.cumsum(need, axis=1)
        place = np.minimum(at[:, None] + order - 1, len(stream) - 1)
        state = np.where(need, state << np.uint64(32) | stream[np.where(need, place, -1)], state)
        at += order[:, -1]
    return out, state


def _packed(*arrays: np.ndarray) -> bytes:
    data = zlib.compress(b"".join(a.tobytes() for a in arrays), 6)
    return struct.pack("<QI", len(data), zlib.crc32(data)) + data


def _unpacked(stream) -> bytes:
    size, check = struct.unpack("<QI", stream.read(12))
    data = stream.read(size)
    if zlib.crc32(data) != check:
        raise ValueError("damaged table or document list")
    return zlib.decompress(data)


def _places(symbols: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The place of each id among the symbols: looked up where ids are small, else searched."""
    if not len(ids) or symbols[-1] >= DENSE:
        return np.searchsorted(symbols, ids).astype(np.uint32)
    at = np.zeros(int(symbols[-1]) + 1, np.uint32)
    at[symbols] = np.arange(len(symbols), dtype=np.uint32)
    return at[ids]


def write_ids(out, keys: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
    """One file: documents' keys (``known``: not null) and lengths, and all their ids in a row."""
    table = Table.of(ids) if len(ids) else Table(np.zeros(1, np.uint32), np.array([1 << 16], np.uint64), 16)
    out.write(MAGIC + struct.pack("<BHHQQQ", table.bits, LANES, PART, len(table.symbols), len(keys), len(ids)))
    out.write(_packed(table.symbols.astype("<u4"), table.counts.astype("<u4")))
    out.write(_packed(keys.astype("<i8"), known.astype("u1"), lengths.astype("<u4")))
    size = LANES * STEPS
    places = _places(table.symbols, ids)
    full = len(ids) // size
    groups = [places[: full * size].reshape(full, STEPS, LANES)] if full else []
    if rest := len(ids) - full * size:
        steps = -(-rest // LANES)
        last = np.zeros(steps * LANES, np.uint32)
        last[:rest] = places[full * size :]
        groups.append(last.reshape(1, steps, LANES))
    block = 0
    for group in groups:
        for states, marks, words in _encode_blocks(group, table):
            part = ids[block * size : (block + 1) * size].astype("<u4")
            data = marks.astype("<u4").tobytes() + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
            out.write(struct.pack("<IIII", len(part), len(words), zlib.crc32(part.tobytes()), zlib.crc32(data)))
            out.write(data)
            block += 1


def _blocks(stream, total: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, checksum of the ids, checkpoint places and states, and stream of each block."""
    while total:
        count, words, check, whole = struct.unpack("<IIII", stream.read(16))
        marks = -(-(-(-count // LANES)) // PART)
        data = stream.read(marks * (4 + 8 * LANES) + 4 * words)
        if zlib.crc32(data) != whole:
            raise ValueError("damaged block")
        places = np.frombuffer(data, "<u4", marks)
        states = np.frombuffer(data, "<u8", marks * LANES, 4 * marks).reshape(marks, LANES)
        yield count, check, places, states, np.frombuffer(data, "<u4", words, marks * (4 + 8 * LANES))
        total -= count


def read_ids(stream) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, which of them are known, lengths and all ids of one file."""
    if stream.read(8) != MAGIC:
        raise ValueError("no file of token ids")
    bits, lanes, part, symbols, docs, total = struct.unpack("<BHHQQQ", stream.read(29))
    if (lanes, part) != (LANES, PART):
        raise ValueError("written with other lanes or checkpoints")
    raw = np.frombuffer(_unpacked(stream), "<u4")
    table = Table(raw[:symbols], raw[symbols:].astype(np.uint64), bits)
    raw = _unpacked(stream)
    keys = np.frombuffer(raw, "<i8", docs)
    known = np.frombuffer(raw, "u1", docs, 8 * docs).astype(bool)
    lengths = np.frombuffer(raw, "<u4", docs, 9 * docs).astype(np.int64)
    blocks = list(_blocks(stream, total))
    out = np.empty((len(blocks), LANES * STEPS), np.uint32)
    # Parts of equal length, of all blocks, go together.
    parts: dict[int, list[tuple[int, int, int, np.ndarray, np.ndarray]]] = {}
    base, streams = 0, [b[4] for b in blocks]
    for b, (count, _, places, states, words) in enumerate(blocks):
        steps = -(-count // LANES)
        for m in range(len(places)):
            end = states[m + 1] if m + 1 < len(places) else np.full(LANES, LOW, np.uint64)
            parts.setdefault(min(PART, steps - m * PART), []).append((b, m, base + int(places[m]), states[m], end))
        base += len(words)
    joined = np.concatenate(streams) if streams else np.zeros(0, np.uint32)
    for steps, group in parts.items():
        b, m, at, first, last = (np.array(x) for x in zip(*group))
        found, ended = _decode_parts(first, at, joined, steps, table)
        if (ended != last).any():
            raise ValueError("a part does not end in the state of the next checkpoint")
        for i in range(len(group)):
            begin = m[i] * PART * LANES
            out[b[i], begin : begin + steps * LANES] = table.symbols[found[i]].ravel()
    ids = []
    for row, (count, check, *_) in zip(out, blocks):
        if zlib.crc32(row[:count].tobytes()) != check:
            raise ValueError("the ids of a block do not match their checksum")
        ids.append(row[:count])
    return keys, known, lengths, np.concatenate(ids) if ids else np.zeros(0, np.uint32)


# A stop or comma before a blank that may belong to a run of signs: not after a Latin letter or digit.
_SIGNS = re.compile(r"[^ A-Za-z0-9À-ÖØ-öø-ÿ][.,] ").search


# Lowered Latin letters, which no Unicode version changes when it lowers or composes them, and signs
# behind them, which the tokenizer parts from the letters; no apostrophe, which may begin an ending.
_LETTERS = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

# What the tokenizer of plain words leaves out: only this is known to do nothing to lowered letters.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


def _plain(tokenizer: Tokenizer) -> tuple[Tokenizer, np.ndarray] | None:
    """The same model without the steps that leave lowered letters between blanks as they are, and
    which ids end a word; None unless the tokenizer's steps are those known to do so."""
    parts = json.loads(tokenizer.to_str())
    model, steps = parts["model"], {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
    suffix = model.get("end_of_word_suffix")
    if parts["normalizer"] != _NORMALIZER or parts["pre_tokenizer"] != steps or not suffix:
        return None
    # All bytes of the letters are known, so that no word goes without its end.
    if not {c + e for c in byte_characters().values() for e in ("", suffix)} <= model["vocab"].keys():
        return None
    # Letters with signs behind hold no added token that has letters between signs.
    if not all(re.fullmatch(r"<\|\w+\|>", t["content"]) for t in parts["added_tokens"]):
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
    parts |= {"normalizer": None, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None}
    parts["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _BYTES]}
    return Tokenizer.from_str(json.dumps(parts)), ends


class WordEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each different word.

    The tokenizer drops white space and splits at it, and nothing of it looks beyond, so a text
    has the ids of its parts between blanks and line ends, one after another. New words go to
    the library many at a time, in one text, with a control sign between them whose single id
    tells where each ends. Words of Latin letters, with or without signs behind, need no such
    sign: an id of the model ends each word, and its steps before the model are left out.
    """

    BETWEEN = "\x01"

    def __init__(self, tokenizer: Tokenizer, most: int = WORDS):
        self.tokenizer, self.most, self.known = tokenizer, most, {"": b""}
        self.plain = _plain(tokenizer)
        self.between = self._ids(self.BETWEEN)
        if len(self.between) != 1:
            raise ValueError("the tokenizer has no single id for the sign between words")

    def _ids(self, text: str, tokenizer: Tokenizer | None = None) -> np.ndarray:
        (found,) = (tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "<u4")

    def _words(self, text: str) -> list[str]:
        """Parts with nothing between them but blanks. The tokenizer lowers letters, so plain
        ones are lowered here, and it parts a word from a stop or comma, unless that follows
        another sign; so fewer different words are left to ask for."""
        text = text.replace("\n", " ")
        if "<|" not in text and _latin(text):  # special tokens are told by their letters
            text = text.lower()
        if not _SIGNS(text):
            text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split(" ")

    def _learn(self, words: list[str]) -> None:
        if self.plain:
            words = self._learn_letters(words)
        plain = [w for w in words if self.BETWEEN not in w]
        if len(plain) < len(words):
            self.known |= {w: self._ids(w).tobytes() for w in words if self.BETWEEN in w}
        for start in range(0, len(plain), 2000):
            part = plain[start : start + 2000]
            found = self._ids(f" {self.BETWEEN} ".join(part))
            ends = np.flatnonzero(found == self.between[0]).tolist()
            for word, a, b in zip(part, [0, *(e + 1 for e in ends)], [*ends, len(found)]):
                self.known[word] = found[a:b].tobytes()

    def _learn_letters(self, words: list[str]) -> list[str]:
        """Learns the words of letters, with signs behind or not; returns the others."""
        matches = [_LETTERS(w) for w in words]
        pairs = [m.groups() for m in matches if m]
        letters = list(dict.fromkeys(a for a, _ in pairs))
        (tokenizer, last), ids = self.plain, {"": b""}
        for start in range(0, len(letters), 2000):
            part = letters[start : start + 2000]
            found = self._ids(" ".join(part), tokenizer)
            ends = (np.flatnonzero(last[found]) + 1).tolist()
            if len(ends) != len(part):
                raise ValueError("the model does not end each word with one id")
            data = found.tobytes()
            for word, a, b in zip(part, [0, *ends], ends):
                ids[word] = data[4 * a : 4 * b]
        for a, signs in pairs:
            if signs not in ids:
                ids[signs] = self._ids(signs).tobytes()
            self.known[a + signs] = ids[a] + ids[signs]
        return [w for w, m in zip(words, matches) if not m]

    def encode(self, text: str) -> np.ndarray:
        words = self._words(text)
        found = list(map(self.known.get, words))
        new = list(dict.fromkeys(w for w, ids in zip(words, found) if ids is None))
        if len(self.known) + len(new) > self.most:
            self.known = {"": b""}
        if new:
            self._learn(new)
            found = [self.known[w] if ids is None else ids for w, ids in zip(words, found)]
        return np.frombuffer(b"".join(found), "<u4")


def _latin(text: str) -> bool:
    """Whether all characters are of Latin-1, whose letters are lowered one by one."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def _word_encoder(definition: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordEncoder(Tokenizer.from_str(definition))


def write_token_files(
    df: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Files of the ids of all texts in ascending order of ``key``; lists them with their starts.

    Nulls come first, as does an empty text's end id: every row has at least that one. Rows with
    the same key follow each other by a hash of their text, over any number of tasks. Returned are ``file``, ``docs``, ``ids``, and
    ``start``: the ids of all files before. Only these cross the driver's tables.
    """
    require(df, key, text)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = df.sparkSession.sparkContext.broadcast(f.read())  # of fixed size
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(
        F.col(key).cast("long").alias("key"), F.col(text).alias("text"),
        F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"),
    )
    # Rows of one key, and even equal rows, are dealt to several tasks where they are many.
    order = ("key", "_hash", "_row")
    ordered = rows.repartitionByRange(number, *order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_encoder(definition.value)
        task, files = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal files, size
            name = f"{folder}/ids-{task:06d}-{files:04d}.rans"
            keys = np.array([k or 0 for k, _ in held], np.int64)
            known = np.array([k is not None for k, _ in held], bool)
            lengths = np.array([len(x) for _, x in held], np.int64)
            ids = np.concatenate([x for _, x in held])
            with written(name) as out:
                write_ids(out, keys, known, lengths, ids)
            row = {"file": name, "task": task, "number": files, "docs": len(held), "ids": len(ids)}
            files, size = files + 1, 0
            held.clear()
            return pa.RecordBatch.from_pylist([row], _LISTED)

        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                for k, t in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    held.append((k, np.append(encoder.encode(t or ""), end)))
                    size += len(held[-1][1])
                    if size >= file_ids:
                        yield flush()
        if held:
            yield flush()

    listed = frozen(ordered.mapInArrow(run, "file string, task int, number int, docs long, ids long"))
    # One row per file.
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


_LISTED = pa.schema(
    [("file", pa.string()), ("task", pa.int32()), ("number", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]
)


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the listed files: ``doc_id``, ``start`` over all files,
    ``n_tokens``, ``ids_crc32``, and with ``with_ids`` the ids themselves."""
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with opened(name) as f:
                    keys, known, lengths, ids = read_ids(io.BufferedReader(f))
                yield _documents(keys, known, lengths, ids, start, with_ids)

    number = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "start").repartition(number, "file").mapInArrow(run, fields)


def _documents(
    keys: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray, start: int, with_ids: bool
) -> pa.RecordBatch:
    edges = np.append(0, np.cumsum(lengths))
    checks = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges, edges[1:])]
    columns = [
        pa.array(keys, mask=~known), pa.array(edges[:-1] + start), pa.array(lengths),
        pa.array(checks, pa.int64()),
    ]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int64))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)

