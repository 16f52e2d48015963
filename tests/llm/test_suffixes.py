from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from sitewatch.llm import queries, suffixes

SPAN = suffixes.SPAN


def brute_force(rows):
    """Per row: kept bytes and spans, straight from the definition."""
    first: dict[bytes, int] = {}
    data = [(k, (t or "").encode()) for k, t in rows]
    for k, b in data:
        if k is not None:
            for i in range(len(b) - SPAN + 1):
                s = b[i : i + SPAN]
                first[s] = min(first.get(s, k), k)
    out = []
    for k, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - SPAN + 1):
            if k is not None and first[b[i : i + SPAN]] < k:
                gone[i : i + SPAN] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((k, kept, edges[::2].tolist(), edges[1::2].tolist()))
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.duplicate_passages(df, **how).collect()
    return [(r["doc_id"], bytes(r["kept"]), r["begins"], r["ends"]) for r in got]


def order(x):
    return sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def corpus(seed, docs=60):
    """Texts from few words with shared passages, near copies and periodic runs."""
    rng = random.Random(seed)
    words = ["ab", "ba", "cab", "dé", "eff", "gh", "the", "漢"]
    passages = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(docs):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a : a + rng.randint(30, len(p))])
        if rng.random() < 0.2:
            parts.append("ab" * rng.randint(10, 120))
        if rows and rng.random() < 0.2:
            old = rng.choice(rows)[1] or ""
            cut = rng.randint(0, len(old))
            parts = [old[:cut] + "!" + old[cut:]]
        rows.append((i if rng.random() < 0.95 else None, " ".join(parts)))
    rows += [(5, rows[5][1]), (5, rows[6][1]), (900, None), (901, ""), (-3, rows[7][1])]
    return rows


@pytest.mark.parametrize("how", [{}, {"group_bytes": 700}, {"group_bytes": 700, "heavy": 1}])
def test_equals_the_definition(spark, how):
    rows = corpus(1)
    assert order(found(spark, rows, **how)) == order(brute_force(rows))


def test_a_very_long_text_and_copies_of_it(spark):
    rng = random.Random(2)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(60_000))
    rows = [(1, long), (2, long[:200] + long[1000:]), (3, "x" * 49), (4, long[-60:])]
    got = {r[0]: r for r in found(spark, rows)}
    assert got[1][2] == [] and got[3][2] == []
    assert got[2][1] == b"" or len(got[2][1]) < 50
    assert got[4][1] == b""


def test_multikey_classes_order_and_equality():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    at, new = suffixes.multikey_classes(keys)
    ordered = [tuple(k) for k in keys[at]]
    assert ordered == sorted(ordered)
    assert new.tolist() == [i == 0 or ordered[i] != ordered[i - 1] for i in range(500)]
    assert suffixes.multikey_classes(np.zeros((0, 4), np.uint64))[0].tolist() == []


def test_empty_table_and_other_columns(spark, no_docs, odd_docs):
    assert suffixes.duplicate_passages(no_docs).collect() == []
    df = odd_docs.selectExpr("doc_id", "text", "lang AS `group`", "source AS target", "n_chars AS kept")
    got = suffixes.duplicate_passages(df)
    assert got.columns == ["doc_id", "group", "target", "begins", "ends", "kept"]
    assert got.count() == df.count()


def test_query_on_the_small_tables(spark, folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")[["doc_id", "text"]]
    want = {
        r[0]: (len((t or "").encode()) - len(r[1]), len(r[2]), hashlib.sha256(r[1]).hexdigest())
        for r, t in zip(brute_force(docs.itertuples(index=False, name=None)), docs["text"])
    }
    got = queries.QUERIES["op2_suffix_dedup"](spark, folder).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_only_buckets_that_occur_take_time():
    assert list(suffixes._runs(np.array([], np.int64))) == []
    assert list(suffixes._runs(np.array([3, 3, 2_000_000, 2_000_001], np.int64))) == [
        (3, 0, 2), (2_000_000, 2, 3), (2_000_001, 3, 4),
    ]


def test_ranges_of_many_grams_are_cut_by_their_hashes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGES", 3)
    rows = corpus(3)
    assert order(found(spark, rows, group_bytes=400)) == order(brute_force(rows))


def test_buckets_of_grams():
    rng = np.random.default_rng(4)
    lead, gram = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    cuts = np.sort(lead)[[1250, 2500, 3750]]
    assert (suffixes._buckets_of(lead, gram, cuts, 4) == np.searchsorted(cuts, lead, "right")).all()
    target = suffixes._buckets_of(lead, gram, cuts, 40)
    assert (target // 10 == np.searchsorted(cuts, lead, "right")).all()
    assert len(np.unique(target)) == 40 and np.bincount(target).max() < 2 * 125
    assert (suffixes._buckets_of(lead, gram, cuts[:0], 7) == gram % np.uint64(7)).all()
