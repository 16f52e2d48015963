from __future__ import annotations

import hashlib

import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewatch.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return bpe.Encoder(ranks, PATTERN)


ALPHABETS = ["the inaonr", "a b\n\t", "é漢😀ü ñ", "0123 .!?'st", "aaab", "\x00\x1c\x85　​'ll"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), *[st.text(alphabet=a, max_size=80) for a in ALPHABETS]))
def test_ids_are_the_librarys(encoder, library, text):
    assert encoder.encode(text) == library.encode_ordinary(text)


def test_every_kind_of_character(encoder, library):
    for first in range(0, 0x110000, 61):
        if not 0xD800 <= first < 0xE000:
            c = chr(first)
            text = f"a{c}1 {c}{c} b"
            assert encoder.encode(text) == library.encode_ordinary(text), hex(first)


def test_small_tables_are_flushed_without_changing_ids(ranks, library):
    encoder = bpe.Encoder(ranks, PATTERN, pieces=5)
    encoder.transducer.most_states, encoder.transducer.most_pairs = 10, 10
    for text in ["thering of the andthing", "x" * 3000, "ab" * 2000 + " the", "thering of the"] * 2:
        assert encoder.encode(text) == library.encode_ordinary(text)
        assert len(encoder.known) <= 5


def test_lookahead_is_bounded(ranks):
    """No more tokens are held back than the longest token has bytes, on runs of any length."""
    machine = bpe.Transducer(ranks)
    longest = max(map(len, ranks))
    state = 0
    for byte in b"aninterestingthing" * 300:
        step = machine.moves.get(state << 8 | byte) or machine._move(state, byte)
        state = step & (1 << 32) - 1
        places = memoryview(machine.places[state]).cast("i").tolist()
        assert places[1] <= longest


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_streaming_decode_of_any_bytes(data, step):
    """Like the standard library's, whatever the cuts between tokens; valid text comes back."""
    tokens = {i: data[i * step : (i + 1) * step] for i in range(len(data) // step + 1)}
    decoder = bpe.StreamingDecoder(tokens)
    got = "".join(decoder.push([i]) for i in tokens) + decoder.finish()
    assert got == data.decode("utf-8", "replace")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(encoder, ranks, text):
    decoder = bpe.StreamingDecoder({r: t for t, r in ranks.items()}, _whole(ranks))
    assert decoder.push(encoder.encode(text)) + decoder.finish() == text


_CACHE = {}


def _whole(ranks):
    return _CACHE.setdefault("w", bpe.WholeTokens({r: t for t, r in ranks.items()}))


def test_query_on_the_small_tables(spark, folder, library):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    want = {}
    for d, t in zip(docs["doc_id"], docs["text"]):
        ids = library.encode_ordinary(t or "")
        joined = " ".join(map(str, ids)).encode()
        want[d] = (len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = queries.QUERIES["op1_byte_bpe"](spark, folder).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_odd_texts_and_clashing_names(spark, odd_docs, no_docs):
    df = odd_docs.withColumn("ids", odd_docs["n_chars"]).withColumn("decoded", odd_docs["lang"])
    back = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH).collect()
    assert sorted((r["text"] or "") for r in back) == sorted(r["decoded"] for r in back)
    assert len(back) == odd_docs.count()
    both = bpe.encode(df, PATH, PATTERN, decoded="decoded").select("text", "decoded").collect()
    assert all((r["text"] or "") == r["decoded"] for r in both) and len(both) == len(back)
    assert bpe.decode(bpe.encode(no_docs, PATH, PATTERN), PATH).collect() == []
    with pytest.raises(ValueError, match="missing"):
        bpe.encode(no_docs.drop("text"), PATH, PATTERN)
