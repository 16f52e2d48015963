"""Byte-pair encoding with word ends, of halves of a text that are then joined.

A text is normalised and cut into pieces at any character, without regard to words. Each piece
is encoded by itself; a piece of a very long text in a task of its own. Neighbours are joined
pairwise, up a tree: around the cut a window is encoded anew, and it grows until it agrees with
both sides. Nothing else is touched. Two kinds of agreement make this exact:

* A blank ends a word on either side, whatever follows. A window between two blanks needs no more.
* Where blanks are far, words are scanned from a place on the left that the cut cannot reach, up
  to the first end of a word that the right side has too; scanning never looks back.
* Within one long word the window is encoded without the rest of the word, and must begin with
  the left side's token and end with the right side's token at its ends. If ``AB`` and ``BC`` are
  encodings for a token ``B``, then so is ``ABC``: a merge across ``A|B`` would be the first one
  due in ``AB`` as well.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer, models

from sitewatch.llm.arrow import require, slices
from sitewatch.sources.scratch import frozen

LEAF = 4096  # characters encoded at a time
PIECE = 1 << 20  # characters of a text that are one task's
WINDOW = 1024  # characters between two blanks that are encoded anew in one go
LONG = 256  # characters of a word that is not remembered
WORDS = 1_000_000  # words whose ids a worker remembers
END = "</w>"

# The tokenizer's words, as a pattern, and the same over ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_words = regex.compile(PATTERN)
_ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
# Characters whose classes the pattern's library and the tokenizer's know alike; and those whose
# lower case and composition do not depend on the version of Unicode or on their neighbours.
_known_classes = re.compile(
    r"[\x00-\u0557\u1e00-\u208e\u20a0-\ua7cd\uac00-\ud7a3\uf900-\uffff]*"
).fullmatch
_plain_case = re.compile(
    r"[\x00-\u03a2\u03a4-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*"
).fullmatch
_blanks = re.compile("[\t-\r \x85\xa0]+")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printed, else one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}


class TreeEncoder:
    """Ids of whole texts, of ``tokenizer``: a model with word ends, over words of ``PATTERN``."""

    def __init__(self, data: str, leaf: int = LEAF, window: int = WINDOW, long: int = LONG):
        self.library = Tokenizer.from_str(data)
        self.leaf, self.window, self.long = leaf, window, long
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.tokens = [""] * size
        for token, i in vocabulary.items():
            self.tokens[i] = token
        self.plain = [t.removesuffix(END) for t in self.tokens]
        self.sizes = np.array([len(t) for t in self.plain])
        self.ends = np.array([t.endswith(END) for t in self.tokens])
        self.to_bytes = byte_characters()
        self.known: dict[str, bytes] = {}
        self.inner = _without_ends(data)

    # Texts and words

    def normalised(self, text: str) -> str:
        """As the library does it; blanks are single spaces."""
        if text.isascii():
            return b" ".join(text.lower().encode().split()).decode()
        if not _plain_case(text):
            return self.library.normalizer.normalize_str(text)
        return _blanks.sub(" ", unicodedata.normalize("NFC", text).lower())

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Normalised texts between special tokens, and the ids of these, in order."""
        pieces = self.parts(text) if self.parts and "<" in text else [text]
        return [
            ("", self.special[p]) if i % 2 else (self.normalised(p), None) for i, p in enumerate(pieces)
        ]

    def scan(self, text: str) -> list[str]:
        if text.isascii():
            return _ascii_words.findall(text)
        if _known_classes(text):
            return _words.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, words: Sequence[str]) -> None:
        """Asks the library for many words in one text: each ends with the one token that has a
        word's end."""
        for start in range(0, len(words), 5000):
            part = words[start : start + 5000]
            (found,) = self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            places = np.flatnonzero(self.ends[ids]) + 1
            if len(places) != len(part):  # never seen; then each by itself
                self.known |= {w: self._word(w).tobytes() for w in part}
                continue
            data, bounds = ids.tobytes(), [0, *(4 * places).tolist()]
            self.known |= {w: data[a:b] for w, a, b in zip(part, bounds, bounds[1:])}

    def _word(self, word: str) -> np.ndarray:
        """One word's ids, from the model; a long word from its halves."""
        signs = word.encode().decode("latin-1").translate(self.to_bytes)
        return self._halves(signs)

    def _halves(self, signs: str) -> np.ndarray:
        if len(signs) <= self.leaf:
            return _ids(self.library.model.tokenize(signs))
        middle = len(signs) // 2
        return self.join_word(self._halves(signs[:middle]), self._halves(signs[middle:]))

    def words_ids(self, words: list[str]) -> np.ndarray:
        """The ids of words, asked for where they are new."""
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")
        except KeyError:
            pass
        new = {w for w in words if w not in self.known}
        self.learn([w for w in new if len(w) <= self.long])
        long = {w: self._word(w).tobytes() for w in new if len(w) > self.long}
        get = self.known.__getitem__
        return np.frombuffer(b"".join(long[w] if w in long else get(w) for w in words), "<u4")

    # Joining

    def join_word(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of a word, from those of two parts of it, the left one encoded like a word."""
        k = 4
        while True:
            i, j = max(len(left) - k, 0), min(k, len(right))
            signs = "".join(self.plain[t] for t in [*left[i:].tolist(), *right[:j].tolist()])
            model = self.library.model if j == len(right) else self.inner
            middle = _ids(model.tokenize(signs))
            # The left side's last token has a word's end that is none, so it never stands here.
            if (i == 0 or middle[0] == left[i]) and (j == len(right) or middle[-1] == right[j - 1]):
                return np.concatenate([left[:i], middle, right[j:]])
            k *= 2

    def _tiles(self, ids: np.ndarray, size: int, last: bool) -> int:
        """How many of the first or last ids cover ``size`` bytes."""
        reach = 64
        while True:
            some = ids[-reach:][::-1] if last else ids[:reach]
            covered = np.cumsum(self.sizes[some])
            if len(covered) and covered[-1] >= size or len(some) == len(ids):
                return int(np.searchsorted(covered, size)) + 1 if size else 0
            reach *= 4

    def join(self, text: str, low: int, cut: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of ``text[low:high]`` from those of its two sides."""
        if low == cut or cut == high or text[cut - 1] == " " or text[cut] == " ":
            return np.concatenate([left, right])
        a = max(text.rfind(" ", low, cut) + 1, low)
        b = text.find(" ", cut, high)
        b = high if b < 0 else b
        x, y = text[a:cut], text[cut:b]
        i = len(left) - self._tiles(left, len(x.encode()), last=True)
        j = self._tiles(right, len(y.encode()), last=False)
        if len(x) + len(y) <= self.window:
            middle = self.words_ids(self.scan(x + y))
        else:
            middle = self._join_unbroken(x, y, left[i:], right[:j])
        return np.concatenate([left[:i], middle, right[j:]])

    def _join_unbroken(self, x: str, y: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of ``x + y``, which has no blank, from those of both.

        A match of the pattern is settled by itself and the three characters after its start or
        the one after its end, so all words of ``x`` that begin four characters (16 bytes at
        most) before its end, but the last word, are words of the whole.
        """
        at = np.append(0, np.cumsum(self.sizes[left]))
        starts = np.append(0, np.flatnonzero(self.ends[left[:-1]]) + 1)
        safe = starts[at[-1] - at[starts] >= 16]
        first = int(safe[-1]) if len(safe) else 0
        tail = x.encode()[at[first] :].decode()
        reach = np.cumsum(self.sizes[right])
        common = set(reach[self.ends[right]].tolist())
        bytes_x, place, middle = len(tail.encode()), 0, []
        for word in self.scan(tail + y):
            end = place + len(word.encode())
            if place < bytes_x < end and len(word) > self.long:
                middle.append(self._join_spanning(word, bytes_x - place, end - bytes_x, left, right))
            else:
                middle.append(self.words_ids([word]))
            place = end
            if place > bytes_x and place - bytes_x in common:
                break
        rest = int(np.searchsorted(reach, place - bytes_x)) + 1
        return np.concatenate([left[:first], *middle, right[rest:]])

    def _join_spanning(self, word: str, before: int, after: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A long word across the cut. What a side has of it stays, unless it is in other words."""
        signs = word.encode().decode("latin-1").translate(self.to_bytes)
        inner = np.flatnonzero(self.ends[left[:-1]])
        last = left[inner[-1] + 1 :] if len(inner) else left
        if self.sizes[last].sum() != before:
            last = self._halves(signs[:before])
        first = right[: np.argmax(self.ends[right]) + 1]
        if self.sizes[first].sum() != after:
            first = self._halves(signs[before:])
        return self.join_word(last, first)

    def join_all(self, text: str, cuts: list[int], ids: list[np.ndarray]) -> np.ndarray:
        """Ids of a whole text from those of its parts, which lie between ``cuts``."""
        if not ids:
            return np.zeros(0, np.uint32)

        def tree(low: int, high: int) -> np.ndarray:
            if high - low == 1:
                return ids[low]
            middle = (low + high) // 2
            return self.join(text, cuts[low], cuts[middle], cuts[high], tree(low, middle), tree(middle, high))

        return tree(0, len(ids))

    def cuts(self, size: int, step: int) -> list[int]:
        return [*range(0, size, step), size] if size else []

    def segment_ids(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts. All new words of them are asked for together."""
        if len(self.known) > WORDS:
            self.known.clear()
        leaves = [[s[a : a + self.leaf] for a in range(0, len(s), self.leaf)] for s in segments]
        words = [[self.scan(leaf) for leaf in some] for some in leaves]
        new = {w for some in words for leaf in some for w in leaf} - self.known.keys()
        self.learn([w for w in new if len(w) <= self.long])
        return [
            self.join_all(s, self.cuts(len(s), self.leaf), [self.words_ids(w) for w in some])
            for s, some in zip(segments, words)
        ]

    def encode_all(self, texts: Sequence[str]) -> list[np.ndarray]:
        pieces = [self.segments(t) for t in texts]
        found = iter(self.segment_ids([s for some in pieces for s, i in some if i is None]))
        return [
            np.concatenate([next(found) if i is None else np.array([i], np.uint32) for _, i in some])
            for some in pieces
        ]

    def decoded(self, ids: np.ndarray) -> str:
        """What the library's decode gives, special tokens included: it has no decoder, so
        tokens stand with a space between them."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def _ids(tokens: list) -> np.ndarray:
    return np.array([t.id for t in tokens], np.uint32)


def _without_ends(data: str) -> models.BPE:
    """The same merges for parts within a word: their last character has no word's end."""
    model = json.loads(data)["model"]
    if model.get("end_of_word_suffix") != END or model.get("continuing_subword_prefix"):
        raise ValueError(f"the tokenizer's words do not end with {END}")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return models.BPE(vocab=model["vocab"], merges=merges)


@lru_cache(maxsize=1)
def _encoder(data: str) -> TreeEncoder:
    """One for each Python worker, which keeps its words from task to task."""
    return TreeEncoder(data)


def _lists(flat: list[np.ndarray]) -> pa.Array:
    starts = np.cumsum([0, *map(len, flat)])
    values = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


def encode(
    df: DataFrame,
    path: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
    piece: int = PIECE,
) -> DataFrame:
    """Adds the ids of ``text`` by the tokenizer file at ``path`` as ``array<int>``, and the text
    they decode to; a null or empty text has none and decodes to the empty text.

    The result is the tokenizers library's, without added tokens; special tokens in a text are
    recognised as the library does. Rows are taken as they are, repeated ones too; columns of the
    outputs' names are replaced. Texts over ``piece`` characters are cut, encoded by as many tasks
    and joined again; what one task then holds of them is the text and its ids.
    """
    require(df, text)
    with open(path, encoding="utf-8") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())  # of fixed size
    df = df.drop(ids, decoded)
    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    result = T.StructType([*fields, *added])
    arrow_result = to_arrow_schema(result)

    def finished(rows: pa.RecordBatch | pa.Table, flat: list[np.ndarray], coder: TreeEncoder) -> list:
        texts = pa.array([coder.decoded(f) for f in flat], pa.string())
        return [*(c.cast(f.type) for c, f in zip(rows.columns, arrow_result)), _lists(flat), texts]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(data.value)
        for batch in batches:
            for part in slices(batch, text):
                flat = coder.encode_all([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays(finished(part, flat, coder), schema=arrow_result)

    is_long = F.coalesce(F.length(text), F.lit(0)) > piece
    short = df.where(~is_long).mapInArrow(whole, result)
    pieces = _pieces(df.where(is_long), text, data, piece)
    names = df.columns

    def joined(table: pa.Table) -> pa.Table:
        coder = _encoder(data.value)
        table = table.sort_by("_piece")
        new = table.column("_begins").to_pylist()
        texts, marks = table.column("_part").to_pylist(), table.column("_special").to_pylist()
        found = [np.frombuffer(b, "<u4") for b in table.column("_ids").to_pylist()]
        out, at = [], 0
        while at < len(new):
            end = at + 1
            while end < len(new) and not new[end]:
                end += 1
            if marks[at] is not None:
                out.append(np.array([marks[at]], np.uint32))
            else:
                sizes = np.cumsum([0, *map(len, texts[at:end])]).tolist()
                out.append(coder.join_all("".join(texts[at:end]), sizes, found[at:end]))
            at = end
        first = table.select(names).slice(0, 1)
        return pa.table(finished(first, [np.concatenate(out)], coder), schema=arrow_result)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(data.value)
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                (found,) = coder.segment_ids([part.column("_part")[0].as_py()])
                column = pa.array([found.astype("<u4").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "_ids"])

    with_ids = T.StructType([*pieces.schema.fields, T.StructField("_ids", T.BinaryType())])
    spread = pieces.repartition("_text", "_piece").mapInArrow(coded, with_ids)
    return short.unionByName(spread.groupBy("_text").applyInArrow(joined, result))


def _pieces(df: DataFrame, text: str, data, piece: int) -> DataFrame:
    """A row for each piece of each text: its number, whether it begins a stretch between special
    tokens, and the id if it is such a token. The columns of ``df`` stand in the first.

    The table is written, so that all tasks see the same names of texts.
    """
    own = T.StructType(
        [
            T.StructField("_text", T.StringType()),
            T.StructField("_piece", T.IntegerType()),
            T.StructField("_begins", T.BooleanType()),
            T.StructField("_special", T.IntegerType()),
            T.StructField("_part", T.StringType()),
        ]
    )
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields], *own.fields])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(data.value)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                name, number = uuid.uuid4().hex, 0
                for segment, special in coder.segments(one.column(text)[0].as_py()):
                    parts = [segment[a : a + piece] for a in range(0, len(segment), piece)] or [""]
                    for i, part in enumerate(parts):
                        mine = [[name], [number], [i == 0], [special], [part]]
                        held = one.columns if number == 0 else [pa.nulls(1, c.type) for c in one.columns]
                        columns = [*held, *mine]
                        yield pa.RecordBatch.from_arrays(
                            [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)],
                            schema=arrow,
                        )
                        number += 1

    return frozen(df.mapInArrow(cut, schema))
