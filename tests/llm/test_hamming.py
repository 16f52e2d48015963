from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewatch.llm import hamming, queries


def nearest(codes, asked, k):
    """By a full scan: (query, rank, key, distance)."""
    out = []
    for q, c in asked:
        ranked = sorted((sum(int(x ^ y).bit_count() for x, y in zip(c, d)), key) for key, d in codes)
        out += [(q, i + 1, key, dist) for i, (dist, key) in enumerate(ranked[:k])]
    return sorted(out)


def rows(df):
    return sorted((r["query"], r["rank"], r["key"], r["distance"]) for r in df.collect())


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("words", [1, 2])
def test_equals_a_scan_with_a_hot_code(spark, words):
    rng = np.random.default_rng(words)
    base = rng.integers(0, 1 << 63, words, dtype=np.uint64)
    codes = []
    for i in range(300):
        code = base.copy()
        if i % 3:  # the others are one code
            for b in rng.integers(0, 64 * words, rng.integers(0, 20)):
                code[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        codes.append((i, [int(x) for x in code]))
    df = spark.createDataFrame([(i, [signed(x) for x in c]) for i, c in codes], "key long, code array<long>")
    asked = [c for c in codes if c[0] % 60 == 0] + [(999, [int(x) for x in rng.integers(0, 1 << 63, words, dtype=np.uint64)])]
    queries_ = spark.createDataFrame([(i, [signed(x) for x in c]) for i, c in asked], "key long, code array<long>")
    assert rows(hamming.nearest(df.repartition(4), queries_, 7, 64 * words)) == nearest(codes, asked, 7)


def test_fewer_codes_than_wanted_and_none(spark):
    df = spark.createDataFrame([(1, [5]), (2, [-1]), (None, [0])], "key long, code array<long>")
    assert rows(hamming.nearest(df, df.where("key = 1"), 5, 64)) == [(1, 1, 1, 0), (1, 2, 2, 62)]
    assert rows(hamming.nearest(df.limit(0), df, 5, 64)) == []
    assert rows(hamming.nearest(df, df.limit(0), 5, 64)) == []


def test_codes_of_odd_vectors(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, [1.0, -1.0, 0.0, 2.0]), (2, None), (3, [1.0]), (4, [nan, None, 3.0, -0.0])],
        "id long, v array<float>",
    ).withColumn("key", F.lit("x"))
    got = hamming.sign_codes(df, "id", "v", 4).collect()
    assert {r["key"]: r["code"] for r in got} == {1: [0b1001], 4: [0b0100]}


def test_query_equals_brute_force(spark, folder):
    table = pd.read_parquet(f"{folder}/embeddings.parquet")
    codes = [(int(i), [sum(1 << b for b, x in enumerate(v) if x > 0)]) for i, v in zip(table["vec_id"], table["embedding"])]
    want = nearest(codes, [c for c in codes if c[0] % 100 == 0], 10)
    got = queries.QUERIES["op7_hamming"](spark, folder).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in got) == want


def test_repeated_rows_count_once(spark):
    """More repeats than neighbours are asked for; keys with two codes; clashing columns."""
    rows = [(1, [5])] * 6 + [(2, [5]), (3, [7]), (4, [-1]), (4, [6]), (None, [5])]
    codes = spark.createDataFrame(rows, "key long, code array<long>").selectExpr("*", "1 AS id", "2 AS distance")
    for k in (1, 2, 3, 4, 9):
        got = hamming.nearest(codes, codes.where("key = 1"), k, 64).orderBy("rank").collect()
        want = sorted({(bin((5 ^ c[0]) & (1 << 64) - 1).count("1"), n) for n, c in rows if n is not None})
        assert [(r["distance"], r["key"]) for r in got] == want[:k]
