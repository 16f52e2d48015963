"""The corpus pipeline: stages over ``documents``.

Quality rules reject documents, of near-duplicates one stays (found by SimHash, those beyond its
radius by minimum hashes, all checked on their shingles: see ``near_duplicates``), passages that another document has
earlier go, sources are mixed to their target weights, and the mix is encoded. Every stage but
the last returns the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm import bpe, mixture, quality, similar, suffixes
from sitewatch.llm.arrow import table
from sitewatch.sources.scratch import frozen

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees, fitted on the labelled ones here.

    A null, empty or short text fails the base rules; repeated rows are judged alike.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    measured = docs.select(*COLUMNS, F.col("text").alias("_measured"))
    return quality.judge(quality.measure(measured, "_measured", model)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, one row: with the smallest key, a null one last.

    Near are documents whose shingles of five words have Jaccard similarity 0.8 or more. The
    SimHash search finds those within 4 of 64 bits. Texts at 0.8 differ in 10 bits on average, too
    many for any search by shards; so documents that it leaves apart are also tried by
    minimum hashes, and every candidate is checked on its shingles. Null, empty and
    blank texts are near each other.
    """
    rows = frozen(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    found = similar.near_duplicates(rows, shingle=5, similarity=0.8, row="_row")
    keyed = rows.select("_row", "doc_id").join(found, "_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    kept = keyed.groupBy("component").agg(first.alias("first")).select("first._row")
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start in an earlier document too; empty ones go.

    Where a span ends within a character, the rest of that character goes with it. A row without
    a key keeps its text; rows of one key do not take from each other.
    """
    found = suffixes.duplicate_passages(docs.select(*COLUMNS), group_bytes=2 << 20, whole_characters=True)
    left = found.withColumn("text", F.decode("kept", "UTF-8")).where("length(text) > 0")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without words may be taken or not."""
    sized = docs.select(*COLUMNS, mixture.word_count("text").alias("_words"))
    mixed = mixture.mix(sized, "_words", weights=(3, 1, 2), share=1.5, ceiling=2)
    return mixture.repeated(mixed).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left; decoding them must give the text again. A null text has none.

    The tables are small ones: workers of the stages before still hold memory.
    """
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN, decoded="decoded", entries=60_000)
    return coded.select(
        "doc_id", "lang", "source", "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("decodes"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mixed_sources),
    ("byte-level BPE", encoded),
]

#: The trees, the fingerprints' hash and the merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


#: Rows that Spark hands to Python at a time: whole texts, so fewer than for narrow tables.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the checkpoint folder and read by the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    with small_batches(spark):
        for _, stage in STAGES[:-1]:
            docs = frozen(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
