from __future__ import annotations

import random
import re

import corpus_pipeline
from sitewatch.llm import similar

# Shingles of a text, and words replaced at its end: similarity (n - m) / (n + m).
PLANTED = {0.8: (900, 100), 0.85: (925, 75), 0.9: (950, 50)}


def plain_jaccard(x, y, shingle=5):
    sets = []
    for text in (x, y):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        sets.append({tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def plain_components(rows, shingle=5, similarity=0.8):
    """Smallest key reachable from each, by comparing all pairs of rows ``(key, text)``."""
    sets = []
    for _, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets.append({tuple(words[i : i + shingle]) for i in range(max(len(words) - shingle, 0) + 1)})
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (k, _) in enumerate(rows):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                x, y = find(k), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k, _ in rows}


def edited(rng, n, m):
    words = [f"w{rng.getrandbits(40)}" for _ in range(n + 4)]
    return " ".join(words), " ".join(words[: n + 4 - m] + [f"v{rng.getrandbits(40)}" for _ in range(m)])


def test_planted_copies_go_and_others_stay(spark):
    rng, rows, copies = random.Random(5), [], []
    for wanted, (n, m) in PLANTED.items():
        for _ in range(20):
            x, y = edited(rng, n, m)
            assert abs(plain_jaccard(x, y) - wanted) < 1e-9
            copies.append(len(rows) + 1)
            rows += [(len(rows), x), (len(rows) + 1, y.upper())]
    for _ in range(20):  # just below
        x, y = edited(rng, 895, 105)
        assert 0.78 < plain_jaccard(x, y) < 0.8
        rows += [(len(rows), x), (len(rows) + 1, y)]
    # Close to a copy only, not to the first text.
    x, y = edited(rng, 950, 50)
    z = " ".join([f"u{i}" for i in range(50)] + y.split()[50:])
    assert plain_jaccard(x, z) < 0.82 and plain_jaccard(y, z) >= 0.8
    copies += [len(rows) + 1, len(rows) + 2]
    rows += [(len(rows), x), (len(rows) + 1, y), (len(rows) + 2, z)]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    left = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(left) == sorted({i for i, _ in rows} - set(copies))


def test_candidates_are_checked():
    x, y = edited(random.Random(2), 900, 100)
    a, b = (similar.shingle_set(t.encode(), 5) for t in (x, y))
    assert len(a) == len(b) == 900 and set(similar.band_keys(a)) & set(similar.band_keys(b))
    assert similar.band_keys(a) == similar.band_keys(similar.shingle_set(x.upper().encode(), 5))
    assert len(similar.shingle_set(None, 5)) == 0 and len(similar.shingle_set(b"one two", 5)) == 1


def _boilerplate(seed, texts, shared, own):
    """Texts with the same beginning and words of their own: similarity shared / (shared + 2 own)."""
    rng = random.Random(seed)
    common = [f"b{i}" for i in range(shared + 4)]
    return [" ".join(common + [f"o{rng.getrandbits(40)}" for _ in range(own)]) for _ in range(texts)]


def test_boilerplate_brings_no_pairs(spark):
    """Hundreds that share a band but are not near are not paired; two near ones among them are."""
    for shared, own in ((600, 330), (600, 80)):  # similarities 0.48 and 0.79
        texts = _boilerplate(shared + own, 400, shared, own)
        texts.append(texts[7] + " and a little more")
        rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
        roots = spark.createDataFrame([], "row long, root long")
        assert [tuple(r) for r in similar.sharing_rare_shingles(rows, roots, 5, 0.8).collect()] == [(7, 400)]
        got = {r["row"]: r["component"] for r in similar.near_duplicates(rows).collect()}
        assert got == {i: 7 if i == 400 else i for i in range(401)}


def test_a_hot_band_against_all_pairs(spark):
    """Copies edited to either side of 0.8, with equal, empty and short texts among them."""
    rng, rows = random.Random(3), []
    base = [f"w{rng.getrandbits(40)}" for _ in range(300)]
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice((0, 2, 5, 8, 12))):
            words[rng.randrange(300)] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(120 + i, t) for i, t in enumerate([None, "", " ", "one", "ONE", "one two three", rows[3][1]])]
    df = spark.createDataFrame(rows, "row long, text string")
    got = {r["row"]: r["component"] for r in similar.near_duplicates(df).collect()}
    assert got == plain_components(rows)
    # Every similar pair meets, whatever the bands say.
    roots = spark.createDataFrame([], "row long, root long")
    met = {tuple(r) for r in similar.sharing_rare_shingles(df.where("row < 120"), roots, 5, 0.8).collect()}
    near = {(i, j) for j in range(120) for i in range(j) if plain_jaccard(rows[i][1], rows[j][1]) >= 0.8 - 1e-9}
    assert near <= met


def test_simhash_links_near_copies_and_bands_the_rest(spark, monkeypatch):
    """Without what the bands find, most copies with one word changed are linked, and nothing else is."""
    rng, rows = random.Random(8), []
    for i in range(40):
        words = [f"w{rng.getrandbits(40)}" for _ in range(600)]
        rows.append((2 * i, " ".join(words)))
        words[rng.randrange(600)] = "changed"
        if i >= 30:  # similarity 0.5
            words[:200] = [f"v{rng.getrandbits(40)}" for _ in range(200)]
        rows.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "row long, text string")
    want = plain_components(rows)
    assert {r["row"]: r["component"] for r in similar.near_duplicates(df).collect()} == want
    monkeypatch.setattr(similar, "links", lambda bands, rows, known, *_: known[1])
    alone = {r["row"]: r["component"] for r in similar.near_duplicates(df).collect()}
    linked = [i for i in range(40) if alone[2 * i + 1] == 2 * i]
    assert len(linked) >= 20 and max(linked) < 30
    assert all(alone[k] in (k, want[k]) for k in alone)
