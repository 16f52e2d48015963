from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitewatch.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        return alignment.Sides(f.read(), g.read())


@pytest.fixture(scope="module")
def library():
    """Plain tokens of one text: ids and bytes, from the libraries and files as they are."""
    ours = Tokenizer.from_file(A)
    ours.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    bytes_of = {chr(b): b for b in printed}
    bytes_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}

    def tokens(text):
        a = ours.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(bytes_of[c] for c in ours.id_to_token(i))) for i in a]
        right = []
        for i in pieces.encode(text):
            p = pieces.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
        return left, right

    return tokens


def plain(text, library):
    """Groups and links of one text, by comparing all tokens with each other."""
    if not text:
        return [], [], [], []
    left, right = library(text)
    whole = b" " + text.encode()
    if b"".join(t for _, t in left) != whole or b"".join(t for _, t in right) != whole:
        return [], [], [], []

    def spans(tokens):
        at, out = 0, []
        for i, t in tokens:
            out.append((at, at + len(t), i))
            at += len(t)
        return out

    left, right = spans(left), spans(right)
    links = [(a[2], b[2]) for a in left for b in right if a[0] < b[1] and b[0] < a[1]]
    groups, low = [], 0
    for end in sorted({s[1] for s in left} & {s[1] for s in right}):
        groups.append([[s[2] for s in side if low <= s[0] < end] for side in (left, right)])
        low = end
    return [s[2] for s in left], [s[2] for s in right], groups, links


def plain_scores(rows, library):
    found = [(k, *plain(t, library)) for k, t in rows]
    counts = Counter(link for *_, links in found for link in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for k, a, b, groups, links in found:
        text = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        out.append(
            (
                k, len(a), len(b), len(groups), len(links), hashlib.sha256(text.encode()).hexdigest() if a else "",
                sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            )
        )
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab the<|>ends▁é漢😀\n\t  .,'1", max_size=80)))
def test_groups_and_links(sides, library, text):
    (got,) = alignment.aligned(sides, [text])
    a, b, groups, links = plain(text, library)
    if not a:
        assert got is None
        return
    assert (got.a.tolist(), got.b.tolist()) == (a, b)
    assert sorted(zip(got.linked_a.tolist(), got.linked_b.tolist())) == sorted(links)
    assert got.text() == ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)


def test_bytes_of_tokens_are_compared_by_stretches(sides, library, monkeypatch):
    monkeypatch.setattr(alignment, "SPELLED", 3)
    text = "the  café 漢 12 <s>\n" * 5
    left, right = library(text)
    whole = np.frombuffer(b" " + text.encode(), np.uint8)
    for vocabulary, tokens in ((sides.vocabulary_a, left), (sides.vocabulary_b, right)):
        ids = np.array([i for i, _ in tokens])
        assert alignment._spells(vocabulary, ids, whole)
        assert not alignment._spells(vocabulary, ids[:-1], whole)
        for at in range(0, len(whole), 7):  # one byte differs, in any stretch
            other = whole.copy()
            other[at] ^= 1
            assert not alignment._spells(vocabulary, ids, other)
    (got,) = alignment.aligned(sides, [text])
    _, _, groups, _ = plain(text, library)
    # Written as bytes, from a table of numbers instead of strings.
    assert got.written() == ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups).encode()
    assert sides.written_a.dtype == sides.written_b.dtype == np.int64


def test_special_strings_are_text(sides, library):
    for text in ("<|endoftext|>", "a <s> b</s> <unk> <0x41>", "▁", " ▁ a"):
        (got,) = alignment.aligned(sides, [text])
        a, *_ = plain(text, library)
        assert (got.a.tolist() if got else []) == a
    assert next(alignment.aligned(sides, ["▁"])) is None


@pytest.mark.parametrize("text", [" " * 300_000, "a" * 50_000, "word\n" * 20_000, "\t" * 10_000 + "x"])
def test_long_runs(sides, library, text):
    (got,) = alignment.aligned(sides, [text])
    left, right = library(text)
    assert got.a.tolist() == [i for i, _ in left] and got.b.tolist() == [i for i, _ in right]


def test_query_on_the_small_tables(spark, folder, library):
    docs = pd.read_parquet(f"{folder}/documents.parquet").sort_values("n_chars")
    got = queries.QUERIES["op12_alignment"](spark, folder)
    want = plain_scores(docs[["doc_id", "text"]].itertuples(index=False, name=None), library)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_odd_rows(spark, odd_docs, no_docs, library, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 60)
    docs = odd_docs.selectExpr("*", "1 AS n_a", "'x' AS groups").repartition(3)
    got = alignment.link_scores(docs, A, B)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == plain_scores(rows, library)
    assert {"lang", "source", "groups"} <= set(got.columns) and "text" not in got.columns
    assert alignment.link_scores(no_docs, A, B).collect() == []


def test_align_gives_ids_and_groups(spark, odd_docs, library):
    for r in alignment.align(odd_docs, A, B).collect():
        a, b, groups, _ = plain(r["text"], library)
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        low_a = low_b = 0
        for got, want in zip(r["groups"], groups, strict=True):
            assert [a[low_a : got["a"]], b[low_b : got["b"]]] == want
            low_a, low_b = got["a"], got["b"]
