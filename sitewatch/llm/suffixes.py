"""Removal of passages that start earlier in another document, by sorting suffixes in buckets.

Every string of ``SPAN`` bytes contains an *anchor*: the place of the smallest hash among its
grams of ``GRAM`` bytes. Equal strings have their anchor at the same place, so it is enough to
compare strings around equal anchors. Neighbouring strings mostly share the anchor; one *context*
holds all of them.

1. Documents are dealt to groups of a few megabytes. Each group lists its different anchor grams;
   buckets answer which of them other groups have as well.
2. Around these, groups send each different context once, with the smallest key that has it.
   Sampled splitters of the grams' leading bytes range-partition them into buckets. Splitters are
   bounded, as is their sample; beyond that many buckets each range is cut by the hash of the whole
   gram, which equal strings share. A bucket
   sorts the suffixes that start in its contexts, cut at ``SPAN`` bytes, by multikey quicksort;
   equal neighbours are equal strings, and their smallest key goes back to the groups that asked.
   A gram with very many contexts would overflow its bucket: its suffixes cross bucket
   boundaries, each of them dealt by a hash of all its bytes, so equal ones still meet.
3. Groups remove what is covered by strings with a key smaller than the document's.

A group sends a context once however many of its documents have it, so a group of copies of any
size costs a bucket no more than one row for each group of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewatch.llm.arrow import require, text_bytes, tidied, tidy

SPAN, GRAM = 50, 16
GRAMS = SPAN - GRAM + 1  # grams of a string, and most strings of a context
WIDTH = 88  # bytes kept of a context: SPAN + GRAMS - 1, in whole words
GROUP_BYTES = 4 << 20  # text in a group of documents, on average
CHUNK = 1 << 18  # bytes whose anchors are found at a time
HEAVY = 20_000  # contexts of a gram beyond which its suffixes are dealt one by one
SAMPLE_BYTES = 32 << 20  # text that the splitters are taken from, about
RANGES = 8192  # ranges of leading bytes; more buckets than these are cut by hashes
MESSAGE = "target int, origin int, kind int, data binary"

_TABLE = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.uint64) * 2 + 1
_POWER = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at every place: of two halves, of two quarters, and so on."""
    out, length, power = _TABLE[data], 1, _POWER
    while length < GRAM:
        out = out[:-length] * np.uint64(power) + out[length:]
        power = power * power % (1 << 64)
        length *= 2
    return _mixed(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    length = 1
    while 2 * length <= width:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    if length < width:
        values = np.minimum(values[: -(width - length)], values[width - length :])
    return values


class Contexts:
    """The contexts of texts laid end to end, in order of place.

    ``place`` of the first string, ``strings`` in it, ``offset`` of the anchor from ``place``,
    ``gram`` hash of the anchor, ``text`` number. A context never leaves its text.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, found = data, []
        for begin in range(0, max(len(data) - SPAN + 1, 0), CHUNK):
            piece = data[begin : begin + CHUNK + SPAN - 1]
            hashes = _gram_hashes(piece)
            # The place in the low bits: of equal hashes the first is the smallest.
            mask = np.uint64((1 << 19) - 1)
            order = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
            anchor = (_least(order, GRAMS) & mask).astype(np.int64)
            # Strings that run out of their text: the last SPAN - 1 places of each.
            i = np.searchsorted(starts, begin, "right")
            j = np.searchsorted(starts, begin + len(anchor) + SPAN, "left")
            ends = starts[i:j] - begin
            outside = np.zeros(len(anchor) + 1, np.int32)
            np.add.at(outside, np.clip(ends - SPAN + 1, 0, len(anchor)), 1)
            np.add.at(outside, np.clip(ends, 0, len(anchor)), -1)
            at = np.flatnonzero(np.cumsum(outside[:-1]) == 0)
            if not len(at):
                continue
            anchor = anchor[at]
            first = np.flatnonzero(
                np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
            )
            place = at[first]
            # An anchor's hash is the smallest of many: mixed again, it is spread evenly.
            gram = _mixed(hashes[anchor[first]] + np.uint64(_POWER))
            found.append((place + begin, np.diff(np.append(first, len(at))), anchor[first] - place, gram))
        if not found:
            found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
        self.place, self.strings, self.offset, self.gram = (np.concatenate(x) for x in zip(*found))
        self.text = np.searchsorted(starts, self.place, "right") - 1

    def bytes_of(self, rows: np.ndarray) -> np.ndarray:
        """``[len(rows), WIDTH]``: the bytes of contexts, with zeros behind."""
        return _cut(self.data, self.place[rows], SPAN - 1 + self.strings[rows])

    def hashes(self, rows: np.ndarray) -> np.ndarray:
        return context_hashes(self.bytes_of(rows), self.strings[rows], self.offset[rows])


def _cut(data: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(places):
        return np.zeros((0, WIDTH), np.uint8)
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[places]
    out[np.arange(WIDTH) >= lengths[:, None]] = 0
    return out


def context_hashes(rows: np.ndarray, strings: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Identity of contexts: their bytes, how many strings, and where the anchor is."""
    words = np.ascontiguousarray(rows).view("<u8")
    out = (strings.astype(np.uint64) << np.uint64(8)) | offset.astype(np.uint64)
    for i in range(words.shape[1]):
        out = _mixed(out * np.uint64(_POWER) + words[:, i])
    return out


def multikey_classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian words, and for each place whether it differs from the one before.

    Multikey quicksort a word at a time: rows are sorted by the first word; only runs of equal
    rows go on to the next.
    """
    n = len(keys)
    order, new = np.arange(n), np.zeros(n, bool)
    if not n:
        return order, new
    new[0] = True
    for word in range(keys.shape[1]):
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        tied = np.flatnonzero(size[run] > 1)
        if not len(tied):
            break
        rows = order[tied]
        inside = np.lexsort((keys[rows, word], run[tied]))
        order[tied] = rows[inside]
        value = keys[order[tied], word]
        new[tied[1:]] |= value[1:] != value[:-1]
    return order, new


def _big_endian(rows: np.ndarray, length: int) -> np.ndarray:
    """The first ``length`` bytes of rows as big-endian words, which compare like the bytes."""
    wide = -(-length // 8) * 8
    cut = np.zeros((len(rows), wide), np.uint8)
    cut[:, :length] = rows[:, :length]
    return cut.view(">u8").astype(np.uint64)


# Messages: named arrays, compressed.


def _message(*arrays: np.ndarray) -> bytes:
    heads = [f"{a.dtype.str}:{len(a)}" for a in arrays]
    body = ";".join(heads).encode() + b"\n" + b"".join(a.tobytes() for a in arrays)
    packed = pa.compress(body, codec="zstd", asbytes=True)
    return len(body).to_bytes(8, "little") + packed


def _arrays(message: bytes) -> list[np.ndarray]:
    size = int.from_bytes(message[:8], "little")
    body = pa.decompress(message[8:], size, codec="zstd", asbytes=True)
    head, at, out = body[: body.index(b"\n")], body.index(b"\n") + 1, []
    for kind, count in (x.split(":") for x in head.decode().split(";")):
        out.append(np.frombuffer(body, kind, int(count), at))
        at += out[-1].nbytes
    return out


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.Table.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["target", "origin", "kind", "data"]
    )


def _pieces(docs: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, bytes and starts of the group's documents, some at a time."""
    keys = docs.column("key").to_numpy()
    data, starts = text_bytes(docs.column("text"))
    begin = 0
    while begin < len(keys):
        end = int(np.searchsorted(starts, starts[begin] + CHUNK, "right")) - 1
        end = min(max(end, begin + 1), len(keys))
        yield keys[begin:end], data[starts[begin] : starts[end]], starts[begin : end + 1] - starts[begin]
        begin = end


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order, and where runs of equal values start in it."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(values) else order


def _ask_grams(docs: pa.Table, buckets: int) -> pa.Table:
    """The group's different anchor grams, and how many contexts each has here (up to 255)."""
    tidy()
    if not docs.num_rows:
        return _table([])
    grams, marks = [], []
    for _, data, starts in _pieces(docs):
        found = Contexts(data, starts)
        grams.append(found.gram)
        marks.append(found.hashes(np.arange(len(found.gram))))
    gram, mark = np.concatenate(grams), np.concatenate(marks)
    _, at = np.unique(mark, return_index=True)
    gram, count = np.unique(gram[at], return_counts=True)
    count = np.minimum(count, 255).astype(np.uint8)
    origin = docs.column("group")[0].as_py()
    target = ((gram >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return _table([(b, origin, 0, _message(gram[x:y], count[x:y])) for b, x, y in _runs(target)])


def _runs(target: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each bucket that occurs in sorted ``target``, and where it begins and ends. However many
    buckets there are, only those that occur take time."""
    if not len(target):
        return
    first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    yield from zip(target[first].tolist(), first.tolist(), [*first[1:].tolist(), len(target)])


def _answer_grams(asked: pa.Table, heavy: int) -> pa.Table:
    """To each group: which of its grams others have too (kind 0), which are heavy (kind 1)."""
    tidy()
    origins = asked.column("origin").to_pylist()
    parts = [_arrays(m) for m in asked.column("data").to_pylist()]
    gram = np.concatenate([p[0] for p in parts])
    count = np.concatenate([p[1] for p in parts]).astype(np.int64)
    order, first = _grouped(gram)
    size = np.diff(np.append(first, len(gram)))
    total = np.add.reduceat(count[order], first)
    repeated, large = gram[order][first][size > 1], gram[order][first][total > heavy]
    rows = []
    for origin, (own, _) in zip(origins, parts):
        for kind, wanted in ((0, repeated), (1, large)):
            if len(wanted):
                at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                if len(hit := own[wanted[at] == own]):
                    rows.append((origin, 0, kind, _message(hit)))
    return _table(rows)


def _listed(answers: pa.Table, kind: int) -> np.ndarray:
    """All values that messages of a kind hold, sorted."""
    found = [
        _arrays(m)[0]
        for m, k in zip(answers.column("data").to_pylist(), answers.column("kind").to_pylist())
        if k == kind
    ]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _singles(found: Contexts, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings of contexts one by one: place, anchor's offset, and row of the context."""
    count = found.strings[rows]
    row = np.repeat(rows, count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return found.place[row] + step, found.offset[row] - step, row


def _send_contexts(docs: pa.Table, answers: pa.Table, splitters: np.ndarray, buckets: int) -> pa.Table:
    """The group's different contexts around repeated grams, each once, to their buckets."""
    tidy()
    if not docs.num_rows:
        return _table([])
    repeated, heavy = _listed(answers, 0), _listed(answers, 1)
    grams, keys_of = [], []
    pieces = []
    for keys, data, starts in _pieces(docs):
        found = Contexts(data, starts)
        pieces.append((keys, found))
        grams.append(found.gram)
        keys_of.append(keys[found.text])
    # Grams of several documents of this group.
    gram, key = np.concatenate(grams), np.concatenate(keys_of)
    if not len(gram):
        return _table([])
    order, first = _grouped(gram)
    low, high = np.minimum.reduceat(key[order], first), np.maximum.reduceat(key[order], first)
    wanted = np.union1d(repeated, gram[order][first][low < high])
    blocks = []
    for keys, found in pieces:
        rows = np.flatnonzero(_is_in(found.gram, wanted))
        large = _is_in(found.gram[rows], heavy)
        plain, split = rows[~large], rows[large]
        blocks.append(
            (found.bytes_of(plain), found.strings[plain], found.offset[plain], keys[found.text[plain]], np.zeros(len(plain), bool), found.gram[plain])
        )
        if len(split):
            place, offset, row = _singles(found, split)
            cut = _cut(found.data, place, np.full(len(place), SPAN))
            blocks.append(
                (cut, np.ones(len(place), np.int64), offset, keys[found.text[row]], np.ones(len(place), bool), found.gram[row])
            )
    rows, strings, offset, key, single, gram = (np.concatenate(x) for x in zip(*blocks))
    if not len(rows):
        return _table([])
    mark = context_hashes(rows, strings, offset)
    order, first = _grouped(mark)
    low, high = np.minimum.reduceat(key[order], first), np.maximum.reduceat(key[order], first)
    at = order[first]
    rows, strings, offset, single, gram, mark = rows[at], strings[at], offset[at], single[at], gram[at], mark[at]
    anchor = np.take_along_axis(rows, offset[:, None] + np.arange(8), axis=1)
    target = _buckets_of(_big_endian(anchor, 8)[:, 0], gram, splitters, buckets)
    target = np.where(single, (mark % np.uint64(buckets)).astype(np.int64), target)
    origin = docs.column("group")[0].as_py()
    order = np.argsort(target, kind="stable")
    out = []
    for b, x, y in _runs(target[order]):
        at = order[x:y]
        inside = np.arange(WIDTH) < (SPAN - 1 + strings[at])[:, None]
        message = _message(
            rows[at][inside], strings[at].astype(np.uint8), offset[at].astype(np.uint8), low[at], high[at]
        )
        out.append((b, origin, 0, message))
    return _table(out)


def _buckets_of(lead: np.ndarray, gram: np.ndarray, splitters: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each gram: the range of its leading bytes, and within it a part by its hash."""
    parts = max(1, round(buckets / (len(splitters) + 1)))
    inside = (gram % np.uint64(parts)).astype(np.int64)
    return np.searchsorted(splitters, lead, "right") * parts + inside


def _answer_contexts(sent: pa.Table) -> pa.Table:
    """The smallest key of every string of every context, to the groups it matters to."""
    tidy()
    origins = sent.column("origin").to_pylist()
    parts = [_arrays(m) for m in sent.column("data").to_pylist()]
    strings = np.concatenate([p[1] for p in parts]).astype(np.int64)
    offset = np.concatenate([p[2] for p in parts]).astype(np.int64)
    low, high = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
    origin = np.repeat(np.array(origins, np.int64), [len(p[1]) for p in parts])
    lengths = SPAN - 1 + strings
    rows = _cut(np.concatenate([p[0] for p in parts]), np.cumsum(lengths) - lengths, lengths)
    # Equal contexts count once.
    mark = context_hashes(rows, strings, offset)
    order, first = _grouped(mark)
    least = np.minimum.reduceat(low[order], first)
    which = np.empty(len(mark), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(mark))))
    unique = order[first]
    # All suffixes of SPAN bytes that start in the different contexts.
    count = strings[unique]
    context = np.repeat(np.arange(len(unique)), count)
    begin = np.cumsum(count) - count
    step = np.arange(len(context)) - begin[context]
    smallest = least[context]
    gram = np.take_along_axis(rows[unique], offset[unique][:, None] + np.arange(GRAM), axis=1)
    gram = context_hashes(np.ascontiguousarray(gram), np.zeros(len(unique)), np.zeros(len(unique)))
    # Where a gram has one context only, its strings are nowhere else.
    order, first = _grouped(gram)
    shared = np.empty(len(gram), bool)
    shared[order] = np.repeat(np.diff(np.append(first, len(gram))) > 1, np.diff(np.append(first, len(gram))))
    compare = np.flatnonzero(shared[context])
    if len(compare):
        flat = rows[unique].ravel()
        at = context[compare] * WIDTH + step[compare]
        padded = np.concatenate([flat, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
        keys = np.empty((len(at), 7), np.uint64)
        for word in range(7):
            value = eights[at + 8 * word].copy().view(">u8").ravel().astype(np.uint64)
            keys[:, word] = value if word < 6 else value >> np.uint64(64 - 8 * (SPAN - 48))
        order, new = multikey_classes(keys)
        first = np.flatnonzero(new)
        found = np.minimum.reduceat(smallest[compare][order], first)
        smallest[compare[order]] = np.repeat(found, np.diff(np.append(first, len(order))))
    # Runs of strings with one smallest key, for each context asked for.
    edge = np.ones(len(context), bool)
    edge[1:] = (context[1:] != context[:-1]) | (smallest[1:] != smallest[:-1])
    run = np.flatnonzero(edge)
    run_end = np.append(run[1:], len(context)) - begin[context[run]]
    run_begin, run_key = step[run], smallest[run]
    runs_of = np.bincount(context[run], minlength=len(unique))
    run_first = np.cumsum(runs_of) - runs_of
    asked = runs_of[which]
    row = np.repeat(np.arange(len(which)), asked)
    pick = np.arange(len(row)) - np.repeat(np.cumsum(asked) - asked, asked) + run_first[which[row]]
    matters = run_key[pick] < high[row]
    row, pick = row[matters], pick[matters]
    out = []
    for o in np.unique(origin[row]):
        at = np.flatnonzero(origin[row] == o)
        out.append(
            (
                int(o), 0, 2,
                _message(
                    mark[row[at]], run_begin[pick[at]].astype(np.uint8),
                    run_end[pick[at]].astype(np.uint8), run_key[pick[at]],
                ),
            )
        )
    return _table(out)


def _covered(found: Contexts, keys: np.ndarray, heavy: np.ndarray, replies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what is to go, in the texts laid end to end."""
    mark, first, last, smallest = replies
    begins, ends = [], []
    everything = np.arange(len(found.gram))
    large = _is_in(found.gram, heavy)
    plain = everything[~large]
    groups = [(found.hashes(plain), found.place[plain], found.text[plain])]
    if large.any():
        place, offset, row = _singles(found, everything[large])
        cut = _cut(found.data, place, np.full(len(place), SPAN))
        groups.append((context_hashes(cut, np.ones(len(place)), offset), place, found.text[row]))
    for own, place, text in groups:
        low, high = np.searchsorted(mark, own, "left"), np.searchsorted(mark, own, "right")
        times = high - low
        row = np.repeat(np.arange(len(own)), times)
        reply = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + low[row]
        goes = smallest[reply] < keys[text[row]]
        row, reply = row[goes], reply[goes]
        begins.append(place[row] + first[reply])
        ends.append(place[row] + last[reply] - 1 + SPAN)
    return np.concatenate(begins), np.concatenate(ends)


def _remove(docs: pa.Table, replies: pa.Table, whole_characters: bool) -> pa.Table:
    """Spans that go, and the bytes that stay, of each document of the group."""
    tidy()
    heavy = _listed(replies, 1)
    parts = [
        _arrays(m)
        for m, k in zip(replies.column("data").to_pylist(), replies.column("kind").to_pylist())
        if k == 2
    ]
    if not parts:
        parts = [[np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.int64)]]
    columns = [np.concatenate(x) for x in zip(*parts)]
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order].astype(np.int64) if i else c[order] for i, c in enumerate(columns)]
    begins_of, ends_of, kept_of = [], [], []
    for keys, data, starts in _pieces(docs):
        begin, end = _covered(Contexts(data, starts), keys, heavy, columns)
        depth = np.zeros(len(data) + 1, np.int32)
        np.add.at(depth, begin, 1)
        np.add.at(depth, end, -1)
        gone = np.cumsum(depth[:-1]) > 0
        for a, b in zip(starts, starts[1:]):
            if not gone[a:b].any():
                begins_of.append([])
                ends_of.append([])
                kept_of.append(data[a:b].tobytes())
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]])))
            begins_of.append(edges[::2])
            ends_of.append(edges[1::2])
            kept = data[a:b][~gone[a:b]].tobytes()
            kept_of.append(kept.decode("utf-8", "ignore").encode() if whole_characters else kept)
    spans = pa.list_(pa.int64())
    return pa.Table.from_arrays(
        [docs.column("rest"), pa.array(begins_of, spans), pa.array(ends_of, spans), pa.array(kept_of, pa.binary())],
        ["rest", "begins", "ends", "kept"],
    )


def _splitters(docs: DataFrame, total: int, buckets: int) -> np.ndarray:
    """At most ``RANGES - 1`` leading words of anchor grams that part a sample of them evenly.

    The sample is bounded by bytes of text, with some fourteen grams for each of the most ranges; it
    decides the balance, never the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(pa.Table.from_batches([batch])):
                found = Contexts(*piece[1:])
                rows = np.flatnonzero(found.gram % np.uint64(16) == 0)
                lead = _big_endian(_cut(found.data, found.place[rows] + found.offset[rows], np.full(len(rows), GRAM)), 8)
                yield pa.RecordBatch.from_arrays([pa.array(lead[:, 0].view(np.int64))], ["lead"])

    ranges = min(buckets, RANGES)
    if ranges < 2:
        return np.zeros(0, np.uint64)
    fraction = min(1.0, SAMPLE_BYTES / max(total, 1))
    found = docs.sample(fraction, seed=5).select("key", "text").mapInArrow(tidied(run), "lead long").toPandas()
    lead = np.sort(found["lead"].to_numpy(np.int64).view(np.uint64))
    if not len(lead):
        return np.zeros(0, np.uint64)
    return np.unique(lead[np.arange(1, ranges) * len(lead) // ranges])


def duplicate_passages(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    group_bytes: int = GROUP_BYTES,
    heavy: int = HEAVY,
    whole_characters: bool = False,
) -> DataFrame:
    """Adds ``begins`` and ``ends`` of the spans to remove, in bytes, and ``kept``, the bytes left.

    A byte goes if it is covered by a string of 50 bytes that also starts in a row with a smaller
    ``key``. Strings are judged on the input, never cross texts, and may overlap; spans are the
    maximal runs of removed bytes. A null text is empty. Rows with the same key do not take from
    each other; rows without a key neither take nor give. ``text`` is replaced by the results.
    With ``whole_characters``, ``kept`` lacks what is left of characters that a span cuts.

    All steps are one query: the documents are shuffled once, and Spark reads that shuffle for
    each step.
    """
    require(df, key, text)
    names = [c for c in df.columns if c not in (text, "begins", "ends", "kept")]
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    # What the caller's columns are called does not matter inside.
    rows = df.select(
        F.struct(*names).alias("rest"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"),
        F.pmod(F.xxhash64(key, text), F.lit(groups)).cast("int").alias("group"),
    )
    docs = rows.where("key IS NOT NULL")
    splitters = _splitters(docs, total, groups)
    by_group = docs.groupBy("group")
    asked = by_group.applyInArrow(lambda t: _ask_grams(t, groups), MESSAGE)
    grams = asked.groupBy("target").applyInArrow(lambda t: _answer_grams(t, heavy), MESSAGE)
    sent = by_group.cogroup(grams.groupBy("target")).applyInArrow(
        lambda left, right: _send_contexts(left, right, splitters, groups), MESSAGE
    )
    found = sent.groupBy("target").applyInArrow(_answer_contexts, MESSAGE)
    replies = found.union(grams.where("kind = 1"))
    result = T.StructType(
        [
            T.StructField("rest", rows.schema["rest"].dataType),
            *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("begins", "ends")],
            T.StructField("kept", T.BinaryType()),
        ]
    )
    removed = by_group.cogroup(replies.groupBy("target")).applyInArrow(
        lambda left, right: _remove(left, right, whole_characters), result
    )
    none = F.array().cast("array<long>")
    whole = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    unkeyed = rows.where("key IS NULL").select(
        "rest", none.alias("begins"), none.alias("ends"), whole.alias("kept")
    )
    return removed.union(unkeyed).select("rest.*", "begins", "ends", "kept")
