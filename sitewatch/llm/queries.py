"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm import (
    alignment, bpe, hamming, hilbert, mixture, quality, rans, simhash, suffixes, toxicity, treebpe, tries, warc,
)
from sitewatch.llm.arrow import table
from sitewatch.llm.files import shared_folder


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text"
    )
    found = suffixes.duplicate_passages(docs)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("begins").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=4, radius=4)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    read = warc.archive_round_trip(pages, shared_folder(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.assess(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality_score")


def op6_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    files = rans.write_token_files(docs, tokenizer, shared_folder(spark, "ids"), end_id=2)
    return rans.read_token_files(files)


def op7_hamming(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    codes = hamming.sign_codes(vectors, "vec_id", "embedding", 64)
    queries = codes.where("key % 100 = 0")
    return hamming.nearest(codes, queries, k, 64).select(
        F.col("query").alias("query_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("key").alias("vec_id"),
        F.col("distance").cast("int").alias("distance"),
    )


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = hilbert.shards(
        docs, ["source", "lang", "size"], ties=["size", "text_crc32", "doc_id"], count=24
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").where(~held_out)
    network = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.drop("lang"), network)
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixture.word_count("text").alias("size")
    )
    mixed = mixture.mix(docs, "size", weights=(3, 1, 2), share=1.5, ceiling=2)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return tries.audit(tries.failures(docs), table(spark, sf_dir, "labels"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path
    return alignment.link_scores(docs, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = treebpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_rans": op6_rans,
    "op7_hamming": op7_hamming,
    "op8_hilbert": op8_hilbert,
    "op9_toxicity": op9_toxicity,
    "op10_mixture": op10_mixture,
    "op11_filter_audit": op11_filter_audit,
    "op12_alignment": op12_alignment,
    "op13_tree_bpe": op13_tree_bpe,
}

ORACLES: dict[str, str] = {
    "op4_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body FROM pages
        ), d AS (
            SELECT page_id, strlen(body) AS n, sha1(body) AS digest,
                   max(page_id) OVER (PARTITION BY body) AS holder
            FROM p
        )
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n < 1000 OR holder IS NULL OR page_id = holder THEN 'response'
                    ELSE 'revisit' END AS record_type,
               CASE WHEN n < 1000 OR page_id = holder THEN NULL ELSE holder END AS refers_to
        FROM d""",
    "op7_hamming": """
        WITH codes AS (
            SELECT vec_id, [x > 0 FOR x IN embedding] AS bits
            FROM embeddings WHERE len(embedding) = 64
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   len(list_filter(list_zip(q.bits, c.bits), lambda x: x[1] <> x[2]))::INTEGER
                       AS distance
            FROM codes q, codes c WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank
            FROM pairs
        )
        SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10""",
    "op11_filter_audit": """
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), failed AS (
            SELECT doc_id, part,
                   [len(w) < 100,
                    100 * len(list_distinct(w)) < 80 * len(w),
                    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
                    regexp_matches(t, '[#$%&*|]'),
                    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
            FROM texts
        ), known AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad
            FROM labels GROUP BY doc_id
        ), masks AS (
            SELECT part, f, count(*) AS n,
                   count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad
            FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, f
        ), letters AS (
            SELECT unnest([1, 2, 3, 4, 5]) AS i
        ), orders AS (
            SELECT [a.i, b.i, c.i, d.i, e.i] AS o
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
        ), steps AS (
            SELECT o, s.i AS step, o[s.i] AS letter FROM orders, letters s
        ), seen AS (
            SELECT part, o, step, letter, n, good, bad, f[letter] AS fails,
                   len(list_filter(o[1:step - 1], lambda x: f[x])) > 0 AS gone,
                   len(list_filter(f, lambda x: x)) = 1 AS once
            FROM masks, steps
        ), counted AS (
            SELECT part, o, step, letter,
                   coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (WHERE fails AND once), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost,
                   coalesce(sum(bad) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost
            FROM seen GROUP BY part, o, step, letter
        )
        SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order,
               step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM counted""",
}
