"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the elementwise smaller of the rows of two hash tables, plus a row for the
word's beginning: a word that shares one row with another by accident does not get its weight.
Filters of widths one to three slide over the embeddings, the maximum of each over the whole
text goes into a logistic output. All labelled documents are learned from: every part of them is
gone through by a task, and after each pass the changes of all parts are averaged. Scores are
calibrated on documents not trained on, and each language gets a threshold of its own.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewatch.llm.arrow import release, require, slices, text_bytes
from sitewatch.sources.scratch import frozen

# Labelled documents of a part, and the most parts: with more documents the parts grow.
PART_DOCS, PARTS = 4096, 256
# Labels that are broadcast, so that only labelled texts are shuffled; more are joined by a shuffle of all.
SENT_LABELS = 2_000_000
# Documents of a step, and words from which fewer documents are one.
BATCH, BATCH_WORDS = 16, 1 << 18
BUCKETS, STARTS = 1 << 17, 1 << 16  # rows of the word tables and of the table of beginnings
DIMS, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PAD = max(WIDTHS) - 1
# Words whose filters are computed at a time.
BLOCK = 1 << 15
# Documents a word must be in to have weights.
LEAST_DOCS = 3
# Changes of weights are added as whole numbers of this part, so that their order makes no difference.
UNIT = 2.0**-28
# Results of a pass reach the driver in so many small pieces.
PIECES = 32

# Rows of the three tables, and the first of each when they lie one after another.
SIZES = (BUCKETS, BUCKETS, STARTS)
FIRST = np.array([[0], [BUCKETS], [2 * BUCKETS]])

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_START_BYTES = 6


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _follow(data: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """The bytes of the characters whose first bytes are marked."""
    out = leads.copy()
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        out[k:] |= (leads & (data >= least))[:-k]
    return out & (leads | (data & 0xC0 == 0x80))


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts that lie one after another begin and end.

    A word is a run of letters of ASCII and of characters below U+0800 (or of the additions to
    Latin and Greek), but for signs. Any other character, of scripts that often go without
    blanks, is a word together with its successor of the same kind: a pair of characters.
    """
    letter = _LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    wide = np.zeros(0, np.int64)
    if len(data) and data.max() >= 0x80:
        second, third = np.append(data[1:], 0), np.append(data[2:], [0, 0])[: len(data)]
        signs = (data == 0xC2) | (data == 0xE2) | ((data == 0xE3) & (second == 0x80))
        signs |= (data == 0xEF) & (second == 0xBC) & (third <= 0xA0)  # full-width
        high = (data >= 0xE0) & ~signs & ~((data == 0xE1) & (second >= 0xB8))
        letter &= ~_follow(data, signs) & ~_follow(data, high)
        wide = np.flatnonzero(high)
    before = np.append(False, letter[:-1]) if len(data) else letter
    after = np.append(letter[1:], False) if len(data) else letter
    begin = np.flatnonzero(letter & (~before | cut[:-1]))
    end = np.flatnonzero(letter & (~after | cut[1:])) + 1
    if len(wide):
        stop = np.minimum(wide + 3 + (data[wide] >= 0xF0), len(data))
        joined = np.append(wide[1:] == stop[:-1], False) & ~cut[stop]
        begin = np.concatenate([begin, wide])
        end = np.concatenate([end, np.where(joined, np.append(stop[1:], 0), stop)])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
    return begin, end


def word_rows(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words of texts that lie one after another, and where each text starts.

    Words are lower-cased in ASCII and Latin-1, and hashed by all their bytes. Row 0 of each
    table stands for no word. A text without words gets one such, and ``PAD`` of them follow each text.
    """
    begin, end = word_spans(data, starts)
    folded = _FOLD[data]
    if len(data):  # capital letters of Latin-1, in UTF-8
        latin = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        folded[latin] += 32
    padded = np.concatenate([np.zeros(8, np.uint8), folded, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = end - begin
    short = np.minimum(length, 8)
    first = eights[begin + 8].copy().view("<u8").ravel() & _MASKS[short]
    last = eights[end].copy().view("<u8").ravel() >> (64 - 8 * short).astype(np.uint64)
    whole = _mixed(first ^ _mixed(last + length.astype(np.uint64)))
    # The ends of a word of up to 16 bytes are all of it.
    for i in np.flatnonzero(length > 16):
        whole[i] = xxhash.xxh64_intdigest(folded[begin[i] : end[i]].tobytes())
    head = _mixed(first & _MASKS[np.minimum(length, _START_BYTES)])
    rows = np.empty((3, len(begin)), np.int32)
    rows[0] = whole % np.uint64(BUCKETS - 1) + np.uint64(1)
    rows[1] = (whole >> np.uint64(32)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    rows[2] = head % np.uint64(STARTS - 1) + np.uint64(1)
    # Places for the words and the paddings.
    words = np.diff(np.searchsorted(begin, starts))
    places = np.maximum(words, 1) + PAD
    offsets = np.append(0, np.cumsum(places))
    out = np.zeros((3, offsets[-1]), np.int32)
    shift = np.repeat(offsets[:-1] - np.append(0, np.cumsum(words))[:-1], words)
    out[:, np.arange(len(begin)) + shift] = rows
    return out, offsets


@dataclass
class Network:
    words: list[np.ndarray]  # two tables [BUCKETS, DIMS]
    heads: np.ndarray  # [STARTS, DIMS]
    filters: list[np.ndarray]  # for each width [width, DIMS, FILTERS]
    bias: np.ndarray  # [widths * FILTERS]
    out: np.ndarray
    shift: float
    scale: float = 1.0  # calibration: score = logistic(scale * output + move)
    move: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.words[0][rows[0]], self.words[1][rows[1]]) + self.heads[rows[2]]

    def convolve(self, vectors: np.ndarray, places: int) -> np.ndarray:
        """Filter outputs at the first ``places`` positions; ``vectors`` has ``PAD`` more."""
        parts = []
        for f in self.filters:
            parts.append(sum(vectors[j : j + places] @ f[j] for j in range(len(f))))
        return np.concatenate(parts, axis=1) + self.bias

    def peaks(
        self, rows: np.ndarray, offsets: np.ndarray, places: bool = True
    ) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of every filter over each text, and the first place that has it.

        Memory is bounded for texts of any length; the places can be left out.
        """
        texts = len(offsets) - 1
        top = np.full((texts, len(self.bias)), -np.inf, np.float32)
        at = np.zeros(top.shape if places else (0, 0), np.int64)
        total = int(offsets[-1])
        rows = np.concatenate([rows, np.zeros((3, PAD), np.int32)], axis=1)
        real = np.ones(total, bool)
        for i in range(1, PAD + 1):
            real[offsets[1:] - i] = False
        for start in range(0, total, BLOCK):
            stop = min(start + BLOCK, total)
            found = self.convolve(self.embed(rows[:, start : stop + PAD]), stop - start)
            found[~real[start:stop]] = -np.inf
            text = np.searchsorted(offsets, start, "right") - 1
            edges = np.append(start, offsets[(offsets > start) & (offsets < stop)])
            block = np.maximum.reduceat(found, edges - start, axis=0)
            here = slice(text, text + len(edges))
            if places:
                same = found == np.repeat(block, np.diff(np.append(edges, stop)), axis=0)
                first = np.where(same, np.arange(start, stop)[:, None], total)
                first = np.minimum.reduceat(first, edges - start, axis=0)
                at[here] = np.where(block > top[here], first, at[here])
            top[here] = np.maximum(top[here], block)
        return top, at

    def pool(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.maximum(self.peaks(rows, offsets, places=False)[0], 0)

    def output(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.pool(rows, offsets) @ self.out + self.shift

    def score(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.scale * self.output(rows, offsets).astype(np.float64) + self.move
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _seen(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """In how many clean and toxic texts each row of the three tables is, one table after another."""
    seen = np.zeros((2, sum(SIZES)), np.int64)
    for rows, label in zip(texts, labels):
        seen[int(label), np.unique(rows + FIRST)] += 1
    return seen


def _begin(seen: np.ndarray, clean: float, toxic: float) -> tuple[Network, list[np.ndarray]]:
    """A network whose first dimension is the evidence of each row: how much more often it is in
    toxic texts, as a log ratio, drawn towards zero where it is rare. Also which rows may learn."""
    rng = np.random.default_rng(9)
    tables, learns = [], []
    for t, (first, size) in enumerate(zip(FIRST.ravel(), SIZES)):
        in_clean, in_toxic = seen[:, first : first + size]
        docs = in_clean + in_toxic
        ratio = np.log((in_toxic + 0.5) / (toxic + 1)) - np.log((in_clean + 0.5) / (clean + 1))
        ratio *= docs / (docs + 5)
        learn = docs >= LEAST_DOCS
        learn[0] = False
        table = np.zeros((size, DIMS), np.float32)
        table[learn, 0] = ratio[learn] * (0.25 if t == 2 else 1)
        table[learn, 1:] = rng.normal(0, 0.1, (int(learn.sum()), DIMS - 1))
        tables.append(table)
        learns.append(learn)
    tables[1][learns[1], 1:] += 0.05  # the smaller of two rows should not always be the second's
    filters = [rng.normal(0, 0.15, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, 0] = 1 / len(f)
    count = FILTERS * len(WIDTHS)
    out = rng.normal(0, 0.05, count).astype(np.float32)
    out[0] = 1.0
    network = Network(tables[:2], tables[2], filters, np.zeros(count, np.float32), out, -3.0)
    if not toxic or not clean:  # nothing to learn
        network.out[:] = 0
        network.shift = 4.0 if toxic else -4.0
    return network, learns


def _start(texts: list[np.ndarray], labels: np.ndarray) -> tuple[Network, list[np.ndarray]]:
    return _begin(_seen(texts, labels), float((1 - labels).sum()), float(labels.sum()))


class Learner:
    """A network that learns by Adagrad, with the squares of its gradients so far."""

    def __init__(self, network: Network, learns: list[np.ndarray], rate: float = 0.05):
        self.network, self.learns, self.rate = network, learns, rate
        self.squares = [np.full_like(x, 1e-2) for x in self.dense]
        self.table_squares = [np.full(len(x), 1e-2, np.float32) for x in self.tables]
        self.shift_square = 1e-2

    @property
    def dense(self) -> list[np.ndarray]:
        return [*self.network.filters, self.network.bias, self.network.out]

    @property
    def tables(self) -> list[np.ndarray]:
        return [*self.network.words, self.network.heads]

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> None:
        """One step of the logistic loss; gradients run through the maxima."""
        network, rows = self.network, np.concatenate(texts, axis=1)
        top, at = network.peaks(rows, np.cumsum([0] + [x.shape[1] for x in texts]))
        pooled = np.maximum(top, 0)
        z = (pooled @ network.out + network.shift).astype(np.float64)
        g = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / BATCH).astype(np.float32)
        back = g[:, None] * network.out * (top > 0)
        gradients = [np.zeros_like(x) for x in network.filters] + [back.sum(axis=0), g @ pooled]
        index: list[list[np.ndarray]] = [[], [], []]
        steps: list[list[np.ndarray]] = [[], [], []]
        for w, f in enumerate(network.filters):
            here = slice(w * FILTERS, (w + 1) * FILTERS)
            for j in range(len(f)):
                near = rows[:, at[:, here] + j]  # [3, texts, FILTERS]
                gradients[w][j] = np.einsum("nkd,nk->dk", network.embed(near), back[:, here])
                step = back[:, here, None] * f[j].T
                lower = network.words[0][near[0]] <= network.words[1][near[1]]
                for t, x in enumerate((step * lower, step * ~lower, step)):
                    index[t].append(near[t].ravel())
                    steps[t].append(x.reshape(-1, DIMS))
        for x, s, d in zip(self.dense, self.squares, gradients):
            s += d * d
            x -= self.rate * d / np.sqrt(s)
        shift = float(g.sum())
        self.shift_square += shift * shift
        network.shift -= self.rate * shift / self.shift_square**0.5
        for t, table in enumerate(self.tables):
            rows_of, inverse = np.unique(np.concatenate(index[t]), return_inverse=True)
            total = np.zeros((len(rows_of), DIMS), np.float32)
            np.add.at(total, inverse, np.concatenate(steps[t]))
            total[~self.learns[t][rows_of]] = 0
            self.table_squares[t][rows_of] += (total * total).mean(axis=1)
            table[rows_of] -= self.rate * total / np.sqrt(self.table_squares[t][rows_of])[:, None]

    def _flat(self) -> np.ndarray:
        """All weights but the tables', then their squares, in rows of ``DIMS``."""
        parts = [*self.dense, np.array([self.network.shift]), *self.squares, np.array([self.shift_square])]
        flat = np.concatenate([np.ravel(x).astype(np.float64) for x in parts])
        return np.append(flat, np.zeros(-len(flat) % DIMS)).reshape(-1, DIMS)

    def changes(self, before: Learner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows differ from ``before``, by how much, and how much the rows' squares do, in units."""
        places, steps, squares = [], [], []
        for first, *x in zip(FIRST.ravel(), self.tables, before.tables, self.table_squares, before.table_squares):
            at = np.flatnonzero((x[0] != x[1]).any(axis=1))
            places.append(first + at)
            steps.append(x[0][at].astype(np.float64) - x[1][at])
            squares.append(x[2][at].astype(np.float64) - x[3][at])
        flat = self._flat() - before._flat()
        places.append(sum(SIZES) + np.arange(len(flat)))
        parts = (np.concatenate([*steps, flat]), np.concatenate([*squares, np.zeros(len(flat))]))
        return np.concatenate(places), *(np.rint(x / UNIT).astype(np.int64) for x in parts)

    def change(self, places: np.ndarray, steps: np.ndarray, squares: np.ndarray) -> None:
        """Add differences."""
        for first, table, own in zip(FIRST.ravel(), self.tables, self.table_squares):
            here = (places >= first) & (places < first + len(table))
            table[places[here] - first] += steps[here]
            own[places[here] - first] += squares[here]
        rest = places >= sum(SIZES)
        flat = self._flat()
        flat[places[rest] - sum(SIZES)] += steps[rest]
        values, start = flat.ravel(), 0
        for x in (*self.dense, None, *self.squares):
            if x is None:
                self.network.shift = float(values[start])
                start += 1
                continue
            x[...] = values[start : start + x.size].reshape(x.shape)
            start += x.size
        self.shift_square = float(values[start])


def balanced(labels: np.ndarray, clean: float, toxic: float) -> np.ndarray:
    """Weights by which both labels weigh alike."""
    return np.where(labels > 0, 0.5 / max(toxic, 1), 0.5 / max(clean, 1)) * (clean + toxic)


def train(texts: list[np.ndarray], labels: np.ndarray, passes: int = 5, rate: float = 0.05) -> Network:
    """A network fitted here on all that is given, both labels weighing alike."""
    network, learns = _start(texts, labels)
    if not 0 < labels.sum() < len(labels):
        return network
    rng, learner = np.random.default_rng(11), Learner(network, learns, rate)
    weight = balanced(labels, float((1 - labels).sum()), float(labels.sum()))
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            at = order[begin : begin + BATCH]
            learner.step([texts[i] for i in at], labels[at], weight[at])
    return network


def calibrate(network: Network, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> None:
    """Scale and shift of the output by weighted logistic regression, with a weak prior."""
    if len(texts) < 20 or not 0 < labels.sum() < len(labels):
        return
    z = np.array([network.output(x, np.array([0, x.shape[1]]))[0] for x in texts])
    x = np.stack([z, np.ones_like(z)], axis=1)
    theta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - labels)) + (theta - prior)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    network.scale, network.move = max(float(theta[0]), 0.05), float(theta[1])


def best_threshold(scores: np.ndarray, labels: np.ndarray, least: int = 8) -> float:
    """The threshold with the highest F1, the middle of the gap it lies in; 0.5 for few labels."""
    if labels.sum() < least or (1 - labels).sum() < least:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(np.argmax(f1))
    below = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + below) / 2)


def _fit_sample(
    docs: DataFrame,
    known: DataFrame,
    counts: dict[int, int],
    key: str,
    text: str,
    lang: str,
    toxic: int | None,
    clean: int | None,
    total_size: int | None,
    text_size: int | None,
) -> Network:
    """A network fitted by the driver on at most ``toxic`` and ``clean`` labelled documents.

    A hash of the key picks them, as long as they have at most ``total_size`` bytes together, for
    either label; one of over ``text_size`` bytes is not fitted on. Their whole texts are turned
    into table rows by tasks, and only these reach the driver. A fifth of them calibrates.
    """
    parts = [
        known.where(F.col("label") == y).orderBy("order", "key").limit(counts.get(y, 0) if n is None else n)
        for y, n in ((1, toxic), (0, clean))
    ]
    fitted = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    sample = frozen(
        fitted.where(F.lit(True) if text_size is None else size <= text_size)
        .join(parts[0].union(parts[1]), "key")
        .groupBy("key", "order", "label")
        .agg(F.min(F.struct("text", "lang")).alias("one"))
        .select("key", "order", "label", "one.*")
    )
    # One row of the sample each, so the window has a bounded number of them.
    until = Window.partitionBy("label").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, 0)
    within = sample.select("key", "label", F.sum(size.cast("long")).over(until).alias("held"))
    within = within.where(F.lit(True) if total_size is None else F.col("held") <= total_size).select("key")
    sample = sample.join(within, "key").select("key", "order", "label", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, offsets = word_rows(*text_bytes(part.column("text")))
                found = [rows[:, a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                columns = [part.column(c) for c in ("key", "order", "label", "lang")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(found, pa.binary())], ["key", "order", "label", "lang", "rows"]
                )

    schema = sample.select("key", "order", "label", "lang").schema.add("rows", T.BinaryType())
    found = sample.mapInArrow(run, schema).toPandas().sort_values(["order", "key"], kind="stable")
    texts = [np.frombuffer(x, np.int32).reshape(3, -1) for x in found["rows"]]
    y = found["label"].to_numpy(np.float64)
    if not len(texts):
        return train([], np.zeros(0))
    aside = np.arange(len(y)) % 5 == 4
    network = train([x for x, a in zip(texts, aside) if not a], y[~aside])
    held = [x for x, a in zip(texts, aside) if a]
    # As many of either label as among all that are labelled.
    share = np.array([counts.get(i, 0) / max((y == i).sum(), 1) for i in (0, 1)])
    calibrate(network, held, y[aside], share[y[aside].astype(int)] / share.max())
    if held:
        scores = np.array([network.score(x, np.array([0, x.shape[1]]))[0] for x in held])
        langs = found["lang"].to_numpy()[aside]
        for name in {x for x in langs if isinstance(x, str)}:
            network.thresholds[name] = best_threshold(scores[langs == name], y[aside][langs == name])
    return network


def _labelled(docs: DataFrame, known: DataFrame, count: int, key: str, text: str, lang: str) -> DataFrame:
    """One row for each of the ``count`` keys ``known``: the smallest text and its language, dealt to parts."""
    parts = min(max(-(-count // PART_DOCS), 1), PARTS)
    known = known.select("key", "label")
    fitted = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = fitted.join(F.broadcast(known) if count <= SENT_LABELS else known, "key")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)).cast("int"))
    return (
        rows.repartitionById(parts, F.col("part"))
        .groupBy("part", "key", "label")
        .agg(F.min(F.struct("text", "lang")).alias("one"))
        .select("part", "key", "label", "one.*", F.xxhash64("key").alias("order"))
        .withColumn("aside", F.pmod("order", F.lit(5)) == 4)
        .sortWithinPartitions("part", "order", "key")
    )


def _words(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The table rows of each text, and the row's other columns."""
    for batch in batches:
        for piece in slices(batch, "text", 2 << 20):
            rows, offsets = word_rows(*text_bytes(piece.column("text")))
            columns = [piece.column(c).to_pylist() for c in names]
            for i, values in enumerate(zip(*columns)):
                yield rows[:, offsets[i] : offsets[i + 1]], *values


def _evidence(rows: DataFrame) -> tuple[np.ndarray, float, float]:
    """In how many clean and toxic texts each table row is, and how many of these texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last place counts the texts.
        seen = np.zeros((2, sum(SIZES) + 1), np.int64)
        for words, label in _words(batches, "label"):
            seen[label, np.unique(words + FIRST)] += 1
            seen[label, -1] += 1
        at = np.flatnonzero(seen.any(axis=0))
        columns = (at.astype(np.int32), *seen[:, at])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["place", "clean", "toxic"])

    counted = rows.select("label", "text").mapInArrow(run, "place int, clean long, toxic long")
    counted = counted.repartition(PIECES, "place").groupBy("place")
    # No more rows than the tables have.
    found = counted.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, sum(SIZES) + 1), np.int64)
    for own, name in zip(seen, ("clean", "toxic")):
        own[found.column("place").to_numpy()] = found.column(name).to_numpy()
    return seen[:, :-1], float(seen[0, -1]), float(seen[1, -1])


def _pass(rows: DataFrame, learner: Learner, clean: float, toxic: float) -> None:
    """Every part is learned from by a copy of ``learner``, which then takes the mean of their changes.

    A row of the tables takes the mean over the parts that met it.
    """
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(learner)  # of fixed size
    steps = [f"d{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = None, None
        held: list[tuple[np.ndarray, int]] = []

        def learn() -> None:
            if held:
                labels = np.array([y for _, y in held])
                own.step([x for x, _ in held], labels, balanced(labels, clean, toxic))
                held.clear()

        def changed() -> Iterator[pa.RecordBatch]:
            if own is not None:
                learn()
                places, moved, squares = own.changes(shared.value)
                columns = [places.astype(np.int32), np.ones(len(places), np.int64), squares, *np.ascontiguousarray(moved.T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "n", "square", *steps])

        for words, label, part in _words(batches, "label", "part"):
            if part != now:
                yield from changed()
                own, now = copy.deepcopy(shared.value), part
            held.append((words, label))
            if len(held) == BATCH or sum(x.shape[1] for x, _ in held) > BATCH_WORDS:
                learn()
        yield from changed()

    schema = "place int, " + ", ".join(f"{c} long" for c in ("n", "square", *steps))
    moved = rows.select("label", "part", "text").mapInArrow(run, schema)
    means = [(F.sum(c) / F.sum("n") * UNIT).cast("float").alias(c) for c in ("square", *steps)]
    # No more rows than the learner has.
    found = moved.repartition(PIECES, "place").groupBy("place").agg(*means).toArrow()
    moves = np.stack([found.column(c).to_numpy() for c in steps], axis=1)
    learner.change(found.column("place").to_numpy(), moves, found.column("square").to_numpy())
    del found, moves
    release()
    shared.destroy()


def _outputs(rows: DataFrame, network: Network) -> DataFrame:
    """``(label, lang, z)``: the network's output for each text."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                z = shared.value.output(*word_rows(*text_bytes(piece.column("text")))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([piece.column("label"), piece.column("lang"), pa.array(z)], ["label", "lang", "z"])

    return rows.select("label", "lang", "text").mapInArrow(run, "label int, lang string, z double")


def _calibrate(network: Network, outputs: DataFrame) -> None:
    """``calibrate`` over a table of outputs: each step of Newton's method adds over all rows."""
    n, hits = outputs.agg(F.count(F.lit(1)), F.sum("label")).first()
    if n < 20 or not 0 < hits < n:
        return
    theta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    z = F.col("z")
    for _ in range(30):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z * float(theta[0]) + float(theta[1])))))
        terms = [z * (p - F.col("label")), p - F.col("label"), z * z * p * (1 - p), z * p * (1 - p), p * (1 - p)]
        # Decimals, so that the order of the rows makes no difference.
        sums = outputs.agg(*(F.sum(t.cast("decimal(28,12)")) for t in terms)).first()
        a, b, c, d, e = map(float, sums)
        step = np.linalg.solve(np.array([[c, d], [d, e]]) + np.eye(2), np.array([a, b]) + theta - prior)
        theta = theta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    network.scale, network.move = max(float(theta[0]), 0.05), float(theta[1])


def _thresholds(network: Network, outputs: DataFrame, least: int = 8) -> dict[str, float]:
    """``best_threshold`` of each language over a table of outputs, equal ones together."""
    each = outputs.where("lang IS NOT NULL").groupBy("lang", "z").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n"))
    each = frozen(each.withColumn("bin", F.floor(F.col("z") * 64)))
    # Counts down to an output are those of the bins above and of the outputs above in the bin.
    bins = each.groupBy("lang", "bin").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), F.max("z").alias("z"))
    down = Window.partitionBy("lang").orderBy(F.desc("bin"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        "lang", "bin", F.coalesce(F.sum("hits").over(above), F.lit(0)).alias("hits_above"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.lead("z").over(down).alias("next_bin"),
    )
    totals = each.groupBy("lang").agg(F.sum("hits").alias("toxic"), F.sum("n").alias("all"))
    inside = Window.partitionBy("lang", "bin").orderBy(F.desc("z"))
    until = inside.rowsBetween(Window.unboundedPreceding, 0)
    hits = F.col("hits_above") + F.sum("hits").over(until)
    n = F.col("n_above") + F.sum("n").over(until)
    below = F.coalesce(F.lead("z").over(inside), "next_bin")
    tried = each.join(bins, ["lang", "bin"]).join(totals, "lang").select("lang", "toxic", "all", (2 * hits / (n + F.col("toxic"))).alias("f1"), "z", below.alias("below"))
    best = tried.groupBy("lang", "toxic", "all").agg(F.max(F.struct("f1", "z", "below")).alias("best"))

    def chance(z: float | None) -> float:
        if z is None:
            return 0.0
        return 1 / (1 + math.exp(-min(max(network.scale * z + network.move, -30), 30)))

    return {
        r["lang"]: (chance(r["best"]["z"]) + chance(r["best"]["below"])) / 2
        if min(r["toxic"], r["all"] - r["toxic"]) >= least else 0.5
        for r in best.collect()
    }


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    lang: str = "lang",
    toxic: int | None = None,
    clean: int | None = None,
    total_size: int | None = None,
    text_size: int | None = None,
    passes: int = 5,
) -> Network:
    """A network fitted on all labelled documents, whole texts of any length.

    Of rows with the same key one is fitted on, the smallest text. A hash of the key sets a fifth
    aside that calibrates and gives the thresholds, and deals the others to parts; tasks go through
    the parts, the changes are averaged after each pass. Only tables of the network's size reach
    the driver. The language serves for the thresholds alone; it is no input of the network.
    Without labels all scores are low. Where the caller bounds the documents of either label or
    the bytes, the network is fitted on such a sample (``_fit_sample``).
    """
    require(docs, key, text, lang)
    require(labels, key, label)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("label"))
    known = frozen(known.withColumn("order", F.xxhash64("key")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(x is not None for x in (toxic, clean, total_size, text_size)):
        return _fit_sample(docs, known, counts, key, text, lang, toxic, clean, total_size, text_size)
    rows = _labelled(docs, known, sum(counts.values()), key, text, lang).persist(StorageLevel.DISK_ONLY)
    try:
        learned, aside = rows.where("NOT aside"), rows.where("aside")
        seen, n_clean, n_toxic = _evidence(learned)
        network, learns = _begin(seen, n_clean, n_toxic)
        if n_clean and n_toxic:
            learner = Learner(network, learns)
            for _ in range(passes):
                _pass(learned, learner, n_clean, n_toxic)
        outputs = frozen(_outputs(aside, network))
    finally:
        rows.unpersist()
    _calibrate(network, outputs)
    network.thresholds.update(_thresholds(network, outputs))
    return network


def score(docs: DataFrame, network: Network, text: str = "text", name: str = "score") -> DataFrame:
    """Replaces ``text`` by its score from 0 to 1; whole texts, null and empty ones too."""
    require(docs, text)
    model = docs.sparkSession.sparkContext.broadcast(network)  # of fixed size
    kept = [c for c in docs.columns if c not in (text, name)]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 2 << 20):
                scores = model.value.score(*word_rows(*text_bytes(part.column(text))))
                columns = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], [*kept, name])

    return docs.select(*kept, text).mapInArrow(run, schema)


def flag(network: Network, score: str = "score", lang: str = "lang") -> Column:
    """Whether a score reaches the threshold of the row's language; 0.5 for one not seen."""
    out = F.lit(0.5)
    for name, threshold in sorted(network.thresholds.items()):
        out = F.when(F.col(lang) == name, F.lit(threshold)).otherwise(out)
    return F.col(score) >= out

