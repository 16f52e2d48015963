"""Quality rules: two base rules and boosted trees over statistics of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewatch.llm import boosting
from sitewatch.llm.arrow import require, slices, tidied

# Labelled rows the trees are fitted on at most, taken in the order of a hash of their key.
FIT_ROWS = 8000
# Words in a window; windows that return within a text count as repetition.
WINDOW = 8
# Words below which a text fails, and the percentage of repeated words above which it does.
LEAST_WORDS, MOST_REPEATED = 20, 30

# White space and symbols of the statistics.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "words", "word_length", "symbols", "dup_lines", "repeated", "different", "capitals",
    "digits", "marks", "line_words", "longest_word",
)
# The score may only fall with these: symbols, repeated lines, repeated words.
MONOTONIC = np.array([0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0])


def _factors(size: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, size, dtype=np.uint64) * 2 + 1


_FACTORS = _factors(WINDOW)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that are found twice or more, the first one included."""
    windows = len(words) - WINDOW + 1
    if windows < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(windows, np.uint64)
    for i in range(WINDOW):
        mixed += hashed[i : i + windows] * _FACTORS[i]
    ordered = np.sort(mixed)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(mixed, again))
    edges = np.zeros(len(words) + 1, np.int64)
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _without(data: bytes, signs: bytes) -> int:
    """How many bytes of ``data`` are among ``signs``."""
    return len(data) - len(data.translate(None, signs))


_CAPITALS, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?"


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts of a text and its features."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    n = len(words)
    chars = len(text) - _without(data, SPACE)
    symbols = _without(data, SYMBOLS)
    dup_lines = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    per_word, per_char = 1 / max(n, 1), 1 / max(chars, 1)
    features = [
        float(np.log1p(n)), chars * per_word, symbols * per_char, dup_lines / max(len(lines), 1),
        repeated * per_word, len(set(words)) * per_word, _without(data, _CAPITALS) * per_char,
        _without(data, _DIGITS) * per_char, _without(data, _MARKS) * per_word,
        float(np.log1p(n / max(len(lines), 1))), float(np.log1p(max(map(len, words), default=0))),
    ]
    return [n, chars, symbols, dup_lines, repeated], features


def measure(df: DataFrame, text: str = "text", model: boosting.Trees | None = None) -> DataFrame:
    """Adds the counts and the array ``features``, without the text; null is a text without words.

    With a model, the features are scored in the same task, and ``quality_score`` takes their
    place. Columns with the names of the results are replaced.
    """
    require(df, text)
    last = T.StructField("features", T.ArrayType(T.DoubleType()))
    if model is not None:
        last = T.StructField("quality_score", T.DoubleType())
    kept = [c for c in df.columns if c not in (*COUNTS, last.name, text)]
    schema = T.StructType(
        [
            *df.select(*kept).schema.fields,
            *[T.StructField(c, T.LongType()) for c in COUNTS],
            last,
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, text)):
            found = [statistics(t.as_py() or "") for t in part.column(text)]
            counts = np.array([c for c, _ in found], np.int64)
            columns = [part.column(c) for c in kept]
            columns += [pa.array(counts[:, i]) for i in range(len(COUNTS))]
            features = np.array([f for _, f in found])
            if model is not None:
                columns.append(pa.array(model.score(features)))
            else:
                columns.append(pa.array(list(features), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(*kept, text).mapInArrow(tidied(run), schema)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = FIT_ROWS,
) -> boosting.Trees:
    """Trees fitted on at most ``rows`` labelled documents; a few numbers of each reach the driver.

    Which rows is decided by a hash of the key, so it does not depend on the order of the input.
    Without labels of both kinds the model is constant, and accepts if there are none at all.
    """
    require(docs, key, text)
    require(labels, key, label)
    sample = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(rows)
    )
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # The sample is bounded by ``rows``.
    chosen = texts.join(F.broadcast(sample), "key")
    found = measure(chosen).select("key", "label", "features").toPandas()
    if not len(found):
        return boosting.constant(1.0)
    found = found.sort_values("key", kind="stable")
    x = np.array(found["features"].tolist(), np.float64)
    return boosting.fit(x, found["label"].to_numpy(np.float64), MONOTONIC)


def judge(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to documents measured with a model.

    A text fails the base rules with fewer than 20 words, or with over 30 % of its words in
    windows that return. What passes them is kept if the trees score it ``threshold`` or more.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality_score") >= threshold)
    )


def assess(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document with its counts, its score and whether it is kept; the text is left out.

    Repeated rows come back as often. Rows without a key are judged like others, but are not
    fitted on.
    """
    return judge(measure(docs, text, fit(docs, labels, key, text)))

