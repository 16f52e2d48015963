from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from sitewatch.llm import graph, queries, simhash


def plain_fingerprint(text, shingle=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    n = min(shingle, len(words))
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints, ids, radius=4):
    parent = list(range(len(ids)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    f = np.array(fingerprints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= radius):
            parent[top(int(j))] = top(i)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return [least[top(i)] for i in range(len(ids))]


def test_query_on_the_small_tables(spark, folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    prints = [plain_fingerprint(t) for t in docs["text"]]
    want = dict(zip(docs["doc_id"], zip((f"{p:016x}" for p in prints), plain_components(prints, docs["doc_id"]))))
    got = queries.QUERIES["op3_simhash"](spark, folder).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def near(seed, n, bits):
    """Fingerprints around few centres, many of them within the radius of others."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        f = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, bits)):
            f ^= 1 << b
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("tree_size", [4096, 20])
@pytest.mark.parametrize("bits", [3, 7])
def test_links_connect_what_all_pairs_would(spark, tree_size, bits):
    f = near(bits, 400, bits)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(f)], "fp long, node long")
    links = simhash.links(df.repartition(5), tree_size=tree_size)
    pairs = links.collect()
    values = np.array(f, np.uint64)
    roots = {r["node"]: r["root"] for r in graph.components(links, "a", "b").collect()}
    assert [roots.get(i, i) for i in range(len(f))] == plain_components(f, list(range(len(f))))
    assert len(pairs) < 400 * 15 * 3
    close = [int(np.bitwise_count(values[a] ^ values[b])) for a, b in pairs]
    assert all(c <= 64 for c in close)


def test_tree_search_equals_a_scan():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 16, 300).astype(np.uint64))
    asked = rng.integers(0, 1 << 16, 50).astype(np.uint64)
    found = {(n, int(q)) for n, at in simhash.BKTree(values).search(asked, 3) for q in at}
    assert found == {
        (i, j) for i, v in enumerate(values) for j, q in enumerate(asked) if int(v ^ q).bit_count() <= 3
    }
    assert list(simhash.BKTree(values[:0]).search(asked, 3)) == []


def test_components_of_a_path_a_star_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    df = spark.createDataFrame([*path, *star, (3, 3), (None, 4), (900, 901)], "a long, b long")
    roots = {r["node"]: r["root"] for r in graph.components(df, "a", "b").collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(200, 260))} | {900: 900, 901: 900}
    assert roots == want
    assert graph.components(df.limit(0), "a", "b").collect() == []


def test_odd_texts(spark, odd_docs, no_docs):
    got = [(r["doc_id"], r["fp"], r["component"]) for r in simhash.near_duplicates(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    assert [g for g in got if g[0] in (0, 1, 2)] and all(g[1:] == (0, 0) for g in got if g[0] in (0, 1, 2))
    assert {g[2] for g in got if g[0] in (5, 6) or g[0] is None} == {5}
    assert simhash.near_duplicates(no_docs).collect() == []
