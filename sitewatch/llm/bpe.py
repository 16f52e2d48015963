"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A sequence of tokens is what merging by rank gives exactly when every two neighbours are
*compatible*: merging the bytes of both gives just these two tokens. So the merges compile to a
nondeterministic transducer whose places are (last token, bytes read of the next one). Its
subsets of places become states only when a text first reaches them. The tokens that all places
of a subset agree on are emitted at once; what they disagree on is at most one token's length of
lookahead. Tables that are full keep what was learned first, which is met most often, so memory
is bounded for any input.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitewatch.llm.arrow import require, resident, slices, tidied

# Entries of each table before it is emptied.
STATES = 200_000
PIECES = 200_000
PAIRS = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank a line."""
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in data.splitlines() if x)}


class Transducer:
    """Bytes in, token ids out, one byte at a time."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES, pairs: int = PAIRS):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.most_states, self.most_pairs = states, pairs
        # Trie of the tokens: node << 8 | byte -> node; node 0 is the root.
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]  # a longer token goes on from here
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                key = node << 8 | byte
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = nxt
            self.token_at[node] = rank
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state is its places, packed: the last token emitted (-1: none, or none of the places
        # depends on it), then for each place the number of tokens held back, these, and the trie
        # node. The place at the root, whose tokens spell all that was read, comes first.
        self.places: list[bytes] = [array("i", (-1, 0, 0)).tobytes()]
        self.numbers: dict[bytes, int] = {self.places[0]: 0}
        # state << 8 | byte -> emission << 32 | next state
        self.moves: dict[int, int] = {}
        self.emissions: list[tuple[int, ...]] = [()]
        self.emission_numbers: dict[tuple[int, ...], int] = {(): 0}

    def _halve(self) -> None:
        """Forgets the states after the first half of the table: those met first stay."""
        keep = self.most_states // 2
        if len(self.emissions) > self.most_states or keep < 2:
            self._reset()
            return
        del self.places[keep:]
        self.numbers = {p: i for i, p in enumerate(self.places)}
        self.moves = {
            k: step for k, step in self.moves.items() if k >> 8 < keep and step & _EMITS - 1 < keep
        }

    def merged(self, data: bytes, below: int = 1 << 62) -> list[int]:
        """Merging by rank, the definition, with the merges ranked lower than ``below``."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte and for one never made."""
        if token not in self._halves:
            parts = self.merged(self.tokens[token], token)
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def made(self, token: int) -> bool:
        """Whether merging the bytes of the token gives the token."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def compatible(self, last: int, token: int) -> bool:
        """Whether merging the bytes of both gives just these two.

        Both are unmade step by step, the later merge first. Had the tokens that met at the
        seam in between a merge ranked before the one just unmade, it would have come first.
        Of equal merges the left one comes first.
        """
        if last < 0:
            return self.made(token)
        key = last << 32 | token
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= self.most_pairs:
                self._pairs.clear()
            known = self._pairs[key] = self.made(token) and self._seam_holds(last, token)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        ranks, tokens, halves = self.ranks, self.tokens, self.halves
        bar = 1 << 62  # a merge at the seam ranked below this would have happened
        while True:
            if ranks.get(tokens[left] + tokens[right], 1 << 62) < bar:
                return False
            a, b = halves(left), halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                left, bar = a[1], left
            else:
                # The merge in the right token comes after one of its rank at the seam.
                right, bar = b[0], right + 1

    def _state(self, places: bytes) -> int:
        number = self.numbers.setdefault(places, len(self.places))
        if number == len(self.places):
            self.places.append(places)
        return number

    def _move(self, state: int, byte: int) -> int:
        child, token_at, inner = self.child, self.token_at, self.inner
        packed = memoryview(self.places[state]).cast("i").tolist()
        last, i, whole, reached = packed[0], 1, None, []
        while i < len(packed):
            end = i + 1 + packed[i]
            node = child.get(packed[end] << 8 | byte)
            if node is not None:
                held = packed[i + 1 : end]
                if inner[node]:
                    reached.append((held, node))
                token = token_at[node]
                # Only one sequence of compatible tokens spells what has been read.
                if token >= 0 and whole is None and self.compatible(held[-1] if held else last, token):
                    whole = [*held, token]
            i = end + 1
        common = len(whole)
        for held, _ in reached:
            common = min(common, len(held))
            while held[:common] != whole[:common]:
                common -= 1
        emitted = tuple(whole[:common])
        if emitted:
            last = emitted[-1]
        if len(whole) > common and all(len(held) > common for held, _ in reached):
            last = -1
        out = [last, len(whole) - common, *whole[common:], 0]
        for held, node in reached:
            out += (len(held) - common, *held[common:], node)
        emission = self.emission_numbers.setdefault(emitted, len(self.emissions))
        if emission == len(self.emissions):
            self.emissions.append(emitted)
        step = self._state(array("i", out).tobytes()) | emission << 32
        self.moves[state << 8 | byte] = step
        return step

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one match of the split pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.places) > self.most_states:
            self._halve()
        state, out, known = 0, [], self.moves.get
        for byte in piece:
            step = known(state << 8 | byte)
            if step is None:
                if len(self.places) > 2 * self.most_states:  # within one very long piece
                    places = self.places[state]
                    self._reset()
                    known = self.moves.get
                    state = self._state(places)
                step = self._move(state, byte)
            if step < _EMITS:
                state = step
            else:
                state = step & _EMITS - 1
                out += self.emissions[step >> 32]
        held = memoryview(self.places[state]).cast("i")
        out += held[2 : 2 + held[1]]
        return out


# Steps from here on emit tokens.
_EMITS = 1 << 32


class Encoder:
    """Whole texts to ids: splits by the pattern, each match through the transducer.

    Matches seen lately are kept with their ids, packed as 32-bit integers.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = PIECES, states: int = STATES):
        self.transducer = Transducer(ranks, states)
        self.split = regex.compile(pattern).findall
        # The same pattern for plain ASCII; the other module reads it faster.
        self.split_ascii = re.compile(ascii_pattern(pattern), re.ASCII).findall
        self.most, self.known = pieces, {}

    def encode_all(self, texts: Iterable[str]) -> list[np.ndarray]:
        known, encode, out = self.known, self.transducer.encode, []
        for text in texts:
            pieces = (self.split_ascii if text.isascii() else self.split)(text)
            new = set(pieces).difference(known)
            if new and len(known) + len(new) > self.most:
                self._forget()
                new = set(pieces).difference(known)
            for piece in new:
                known[piece] = pack("<%di" % len(ids := encode(piece.encode())), *ids)
            out.append(np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<i4"))
            if len(known) > self.most:  # one text with more different matches
                self._forget()
        return out

    def _forget(self) -> None:
        """Drops all but the first half of the matches: those met first are met most often."""
        for piece in list(self.known)[self.most // 2 :]:
            del self.known[piece]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


def ascii_pattern(pattern: str) -> str:
    """``pattern`` over ASCII texts, in the syntax of ``re``."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]")
    return out.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")


class Utf8Machine:
    """Accepts UTF-8 byte by byte: how many bytes are still due, and the range of the next one."""

    def __init__(self) -> None:
        self.due, self.low, self.high = 0, 0x80, 0xBF

    def feed(self, byte: int) -> bool:
        """True if the byte fits here. After False the machine stands at a character's start."""
        if not self.due:
            if byte < 0x80:
                return True
            if 0xC2 <= byte <= 0xDF:
                self.due = 1
            elif 0xE0 <= byte <= 0xEF:
                self.due = 2
                self.low = 0xA0 if byte == 0xE0 else 0x80
                self.high = 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self.due = 3
                self.low = 0x90 if byte == 0xF0 else 0x80
                self.high = 0x8F if byte == 0xF4 else 0xBF
            else:
                return False
            return True
        fits = self.low <= byte <= self.high
        self.low, self.high = 0x80, 0xBF
        self.due = self.due - 1 if fits else 0
        return fits


class StreamingDecoder:
    """Ids in, text out as soon as its characters are complete.

    A token whose bytes are whole characters passes at once when nothing is pending; other
    tokens go through the machine byte by byte. Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, tokens: dict[int, bytes], whole: WholeTokens | None = None):
        self.tokens, self.whole = tokens, whole or WholeTokens(tokens)
        self.machine, self.pending = Utf8Machine(), b""

    def _byte(self, byte: int) -> str:
        out = ""
        if not self.machine.feed(byte):
            if self.pending:
                out, self.pending = "�", b""
                if self.machine.feed(byte):
                    return out + self._took(byte)
            return out + "�"
        return self._took(byte)

    def _took(self, byte: int) -> str:
        self.pending += bytes((byte,))
        if self.machine.due:
            return ""
        out, self.pending = self.pending.decode(), b""
        return out

    def push(self, ids: Sequence[int]) -> str:
        ids, texts = np.asarray(ids, np.int64), self.whole.texts
        values = ids.tolist()
        found = list(map(texts.__getitem__, values))
        odd = np.flatnonzero(~self.whole.mask[ids]).tolist()
        if self.pending:
            odd.insert(0, 0)
        # Byte by byte from a token that is not whole characters on, until none is open.
        end = 0
        for i in odd:
            while i >= end and i < len(values):
                found[i] = "".join(map(self._byte, self.tokens[values[i]]))
                i = end = i + 1
                if not self.pending:
                    break
        return "".join(found)

    def finish(self) -> str:
        out, self.pending, self.machine = "�" * bool(self.pending), b"", Utf8Machine()
        return out


class WholeTokens:
    """Which tokens are whole characters by themselves, and their text."""

    def __init__(self, tokens: dict[int, bytes]):
        self.mask = np.zeros(max(tokens, default=0) + 1, bool)
        self.texts = [""] * len(self.mask)
        for i, data in tokens.items():
            machine = Utf8Machine()
            if all(map(machine.feed, data)) and not machine.due:
                self.mask[i], self.texts[i] = True, data.decode()


# Whose tables a Python worker keeps, see ``arrow.resident``.
OWNER = "byte-level BPE"


def _tables(data: bytes, pattern: str, entries: int) -> tuple[Encoder, dict[int, bytes], WholeTokens]:
    """One set for each Python worker, which keeps it from task to task."""

    def make() -> tuple[Encoder, dict[int, bytes], WholeTokens]:
        ranks = read_ranks(data)
        tokens = {r: t for t, r in ranks.items()}
        return Encoder(ranks, pattern, entries, entries), tokens, WholeTokens(tokens)

    return resident(OWNER, (data, pattern, entries), make)


def _vocabulary(data: bytes) -> tuple[dict[int, bytes], WholeTokens]:
    def make() -> tuple[dict[int, bytes], WholeTokens]:
        tokens = {r: t for t, r in read_ranks(data).items()}
        return tokens, WholeTokens(tokens)

    return resident(OWNER, data, make)


def _rank_file(df: DataFrame, ranks_path: str):
    """The rank file, as a broadcast: of fixed size, so executors need no such file."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = None,
    entries: int = STATES,
) -> DataFrame:
    """Adds the token ids of ``text`` as ``array<int>``; a null or empty text has none.

    With ``decoded``, a column of that name gets the text that the ids decode to, in the same
    task, so that a check of the round trip needs no second worker beside the encoder's.

    A worker's tables hold ``entries`` states and as many matches: some 250 MB for 200,000 and half
    of that for 60,000, with which encoding takes about twice as long.

    Every match of ``pattern`` is encoded by itself, without special tokens. Whole texts are
    encoded, of any length; rows are taken as they are, repeated ones too. A column of the
    output's name is replaced.
    """
    require(df, text)
    data = _rank_file(df, ranks_path)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded:
        added.append(T.StructField(decoded, T.StringType()))
    df = df.drop(*[f.name for f in added])
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens, whole = _tables(data.value, pattern, entries)
        for batch in batches:
            for part in slices(batch, text):
                flat = encoder.encode_all(t or "" for t in part.column(text).to_pylist())
                starts = np.cumsum([0, *map(len, flat)])
                column = pa.ListArray.from_arrays(
                    pa.array(starts, pa.int32()), pa.array(np.concatenate(flat), pa.int32())
                )
                columns = [*part.columns, column]
                if decoded:
                    columns.append(pa.array([_decoded(x, tokens, whole) for x in flat], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(tidied(run, OWNER), schema)


def _decoded(ids: Sequence[int], tokens: dict[int, bytes], whole: WholeTokens) -> str:
    decoder = StreamingDecoder(tokens, whole)
    return decoder.push(ids) + decoder.finish()


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of token ids; null ids are no ids, an unknown id fails.

    A column of the output's name is replaced.
    """
    require(df, ids)
    data = _rank_file(df, ranks_path)
    df = df.drop(text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, whole = _vocabulary(data.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                known = [r.values.to_numpy(zero_copy_only=False) if r.is_valid else () for r in part.column(ids)]
                column = pa.array([_decoded(x, tokens, whole) for x in known], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, text])

    return df.mapInArrow(tidied(run, OWNER), schema)

