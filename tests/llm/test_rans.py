from __future__ import annotations

import io
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitewatch.llm import queries, rans
from sitewatch.llm.files import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def written(ids, lengths):
    out = io.BytesIO()
    keys = np.arange(len(lengths))
    rans.write_ids(out, keys, keys != 1, np.array(lengths), np.array(ids, np.uint32))
    return out.getvalue()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 16384, 16385, 65535, 65536, 65537, 200_001])
def test_round_trip_at_every_edge(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_000).astype(np.uint32)
    data = written(ids, [n // 2, n - n // 2])
    keys, known, lengths, back = rans.read_ids(io.BytesIO(data))
    assert (back == ids).all() and lengths.sum() == n
    assert keys.tolist() == [0, 1] and known.tolist() == [True, False]
    if n > 60_000:  # close to the entropy
        _, counts = np.unique(ids, return_counts=True)
        p = counts / n
        assert len(data) < 1.1 * n * -(p * np.log2(p)).sum() / 8 + 60_000


def test_one_symbol_and_all_different():
    for ids in ([7] * 70_000, list(range(100_000))):
        assert rans.read_ids(io.BytesIO(written(ids, [len(ids)])))[3].tolist() == ids


def test_every_damaged_byte_is_found():
    ids = np.random.default_rng(0).integers(0, 50, 3000)
    data = written(ids, [3000])
    rng = np.random.default_rng(1)
    for at in rng.integers(0, len(data), 150):
        bad = bytearray(data)
        bad[at] ^= 1 << int(rng.integers(0, 8))
        with pytest.raises(Exception):  # noqa: B017
            keys, known, lengths, back = rans.read_ids(io.BytesIO(bytes(bad)))
            assert back.tolist() == ids.tolist() and len(lengths) == 1


def test_parts_decode_on_their_own():
    """From a checkpoint alone, without what stands before it in the block."""
    ids = np.random.default_rng(2).integers(0, 300, 65_536).astype(np.uint32)
    table = rans.Table.of(ids)
    blocks = np.searchsorted(table.symbols, ids).astype(np.uint32).reshape(1, rans.STEPS, rans.LANES)
    ((states, places, stream),) = rans._encode_blocks(blocks, table)
    found, end = rans._decode_parts(states[2:3], places[2:3], stream, rans.PART, table)
    assert (found[0] == blocks[0, 2 * rans.PART : 3 * rans.PART]).all() and (end[0] == states[3]).all()


ALPHABET = "aéA.,_́ΣσÀ\x0b\x1c　\t\n  '’st1½😀İ\r\x85\x01|<"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet=ALPHABET, max_size=20), st.text(max_size=30)))
def test_ids_are_the_librarys(library, text):
    encoder = _ENCODERS.setdefault(0, rans.WordEncoder(library, most=50))
    for t in (text, f"{text} <|endoftext|> {text}", f"{text} <|ENDOFTEXT|>"):
        assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(encoder.known) <= 51


_ENCODERS: dict = {}


def test_words_of_letters_go_to_the_model_alone(library):
    encoder = rans.WordEncoder(library)
    asked = []
    ids = encoder._ids
    encoder._ids = lambda text, *plain: (asked.append((text, bool(plain))), ids(text, *plain))[1]
    words = "Straße ÉTÉ naïve, don't xyzzyqq$$$ abc<| ªº µx a_b foo123 ΣΑΣ plain"
    for text in (words, words.lower(), "é\u0301 K İx " + words, "a'" + words):
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert any(plain and "plain" in text and "\x01" not in text for text, plain in asked)
    assert not any("xyzzyqq" in text for text, plain in asked if not plain)
    every = " ".join(f"{a}x{b}" for a in map(chr, range(33, 256)) for b in map(chr, range(33, 256)))
    assert encoder.encode(every).tolist() == library.encode(every, add_special_tokens=False).ids


def test_places_of_small_and_large_ids():
    for ids in ([], [5, 3, 3, 0, 49_000], [rans.DENSE + 7, 3, 3]):
        ids = np.array(ids, np.uint32)
        symbols = np.unique(ids)
        assert (symbols[rans._places(symbols, ids)] == ids).all()


def plain(docs, library):
    start, out = 0, []
    for d, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_on_the_small_tables(spark, folder, library):
    docs = pd.read_parquet(f"{folder}/documents.parquet").sort_values("doc_id")
    got = queries.QUERIES["op6_rans"](spark, folder).collect()
    want = plain(docs[["doc_id", "text"]].itertuples(index=False, name=None), library)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_files_roll_and_odd_rows_come_back(spark, odd_docs, no_docs, library):
    folder = shared_folder(spark, "ids")
    files = rans.write_token_files(odd_docs, PATH, folder, 2, file_ids=100)
    assert files.count() > 2
    got = rans.read_token_files(files, with_ids=True).collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    want = plain([(r["doc_id"], r["text"]) for r in rows], library)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want
    assert all(r["ids"][-1] == 2 for r in got)
    empty = rans.write_token_files(no_docs, PATH, shared_folder(spark, "ids"), 2)
    assert rans.read_token_files(empty).collect() == []
