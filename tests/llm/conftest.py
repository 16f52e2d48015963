from __future__ import annotations

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """Tests name the folder that a cluster would name."""
    folder = tmp_path_factory.mktemp("shared")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return folder


# Texts that every operator must take: none, empty, blank, short, with ties, very long, odd signs.
ODD_TEXTS = [
    None, "", " \n\t ", "one", "one", "One two three four five six", "one two three four five six",
    "a\x00b\x01c \x1f \x85 　end", "<|endoftext|> and <|startoftext|>", "ÄÖÜ äöü ß É é 漢字 😀 é",
    "x" * 5000, "the same words again " * 400, "line\nline\nline\n\nother line\n", "###*** $$%% | & < >",
]


@pytest.fixture
def odd_docs(spark):
    """The odd texts, with a repeated row, a null key, and columns named like results."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "one two three four five six", "de", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
