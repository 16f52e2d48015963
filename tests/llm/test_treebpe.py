from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitewatch.llm import queries, treebpe

PATH = public_tokenizers.path("word_bpe_49k.json")
with open(PATH, encoding="utf-8") as f:
    DATA = f.read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoders():
    """Leaves and windows from a few characters up, so that nearly every text is joined."""
    sizes = ((7, 0, 3), (16, 8, 5), (64, 30, 20), (4096, 1024, 256))
    return [treebpe.TreeEncoder(DATA, leaf, window, long) for leaf, window, long in sizes]


BITS = [
    "a", "b", "the", "'", "s", "'re", "!", "!!", " ", "  ", "\n", "1", "23", "é", "É", "é", "́", "Σ", "ß",
    "İ", "漢", "字", "😀", "-", "'ll", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\x85", "\xa0", "　", "\x1c",
    "xxxxxxxxx", "in", "ing", "th", "\U00010940", "՘", "’", "“", "ά",
]


@settings(max_examples=400, deadline=None)
@given(
    st.one_of(
        st.lists(st.sampled_from(BITS), max_size=120).map("".join),
        st.tuples(st.sampled_from(BITS), st.sampled_from(BITS), st.integers(1, 60)).map(lambda x: (x[0] * 3 + x[1]) * x[2]),
        st.text(max_size=60),
    )
)
def test_ids_and_texts_are_the_librarys(library, encoders, text):
    want = library.encode(text, add_special_tokens=False).ids
    for encoder in encoders:
        assert encoder.encode_all([text])[0].tolist() == want
        assert encoder.decoded(np.array(want, np.uint32)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("unit, times", [("abcdefghij", 30_000), ("aB1!", 20_000), ("a", 100_000), ("漢字x", 9_000), ("!'", 9_000)])
def test_long_text_without_blanks(library, encoders, unit, times):
    text = unit * times
    assert encoders[-1].encode_all([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_windows_stay_small(encoders):
    """Joining leaves the tokens away from the cut alone: few of them are encoded again."""
    encoder, asked = treebpe.TreeEncoder(DATA), []
    rng = np.random.default_rng(0)
    word = "".join(rng.choice(list("etaoinshrdlu"), 40_000))
    tokenize = encoder.inner.tokenize

    class Counting:
        def tokenize(self, signs):
            asked.append(len(signs))
            return tokenize(signs)

    encoder.inner = Counting()
    encoder.encode_all([word])
    assert len(asked) >= 9 and sum(asked) < 1000


def test_classes_where_the_patterns_library_is_trusted(library):
    """Every character of the trusted ranges is a word, a digit, a sign or a blank to both."""
    trusted = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and treebpe._known_classes(chr(c))]
    for start in range(0, len(trusted), 4000):
        text = " ".join(f"a{c}1!{c}a" for c in trusted[start : start + 4000])
        spans = [span for _, span in library.pre_tokenizer.pre_tokenize_str(text)]
        assert spans == [m.span() for m in treebpe._words.finditer(text)]


def plain(rows, library):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    out = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((k, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_query_on_the_small_tables(spark, folder, library):
    docs = pd.read_parquet(f"{folder}/documents.parquet")[["doc_id", "text"]]
    got = queries.QUERIES["op13_tree_bpe"](spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs.itertuples(index=False, name=None), library)


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_odd_rows(spark, odd_docs, no_docs, library, piece):
    docs = odd_docs.selectExpr("*", "1 AS ids", "'x' AS decoded")
    got = treebpe.encode(docs, PATH, piece=piece)
    assert got.columns == [*odd_docs.columns, "ids", "decoded"]
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((*r, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert treebpe.encode(no_docs, PATH, piece=piece).collect() == []


def test_pieces_of_a_long_text(spark, library):
    text = "Some words, and <|endoftext|> more; " * 300 + "nothing" * 2000 + " é" * 500
    docs = spark.createDataFrame([(1, text), (2, "short"), (1, text)], "doc_id long, text string")
    got = treebpe.encode(docs, PATH, piece=777).orderBy("doc_id").collect()
    want = library.encode(text, add_special_tokens=False).ids
    assert [r["ids"] == want for r in got] == [True, True, False]
    assert [r["text"] == text for r in got] == [True, True, False]
