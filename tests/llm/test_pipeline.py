from __future__ import annotations

import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sitewatch.llm import bpe, simhash
from sitewatch.sources.scratch import frozen
from tests.llm.test_similar import plain_components
from tests.llm.test_suffixes import brute_force

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and gave back."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = frozen(stage(spark, docs, SMALL))
        out.append((name, docs.toPandas(), after.toPandas()))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [n for n, _, _ in stages] == [
        "quality rules", "near-duplicates", "suffix-array dedup", "mixing sources", "byte-level BPE",
    ]
    for _, _, after in stages[:-1]:
        assert list(after.columns) == corpus_pipeline.COLUMNS


def test_quality_rules_reject_some_and_change_nothing(stages):
    _, before, after = stages[0]
    assert 0 < len(after) < len(before)
    assert after["text"].map(lambda t: len(t.split())).min() >= 20
    kept = before[before["doc_id"].isin(after["doc_id"])].sort_values("doc_id")
    pd.testing.assert_frame_equal(kept.reset_index(drop=True), after.sort_values("doc_id").reset_index(drop=True))


def test_one_of_each_group_stays(stages):
    """The smallest key of each component of pairs of similarity 0.8, all pairs compared."""
    _, before, after = stages[1]
    rows = list(zip(before["doc_id"], before["text"]))
    found = plain_components(rows)
    assert sorted(after["doc_id"]) == sorted({found[k] for k, _ in rows})
    assert len(after) < len(before)


def test_passages_go(stages):
    _, before, after = stages[2]
    want = {k: kept.decode("utf-8", "ignore") for k, kept, _, _ in brute_force(zip(before["doc_id"], before["text"]))}
    assert dict(zip(after["doc_id"], after["text"])) == {k: t for k, t in want.items() if t}
    assert (after["n_chars"] == after["text"].str.len()).all()


def test_the_mix_repeats_documents(stages):
    _, before, after = stages[3]
    times = after.groupby("doc_id").size()
    assert times.max() <= 2 and set(times.index) <= set(before["doc_id"])
    words = before["text"].str.split().str.len().sum()
    assert after["text"].str.split().str.len().sum() == pytest.approx(1.5 * words, rel=0.02)


def test_ids_are_the_librarys(stages):
    _, before, after = stages[4]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    text = dict(zip(before["doc_id"], before["text"]))
    assert len(after) == len(before) and after["decodes"].all()
    for d, ids in zip(after["doc_id"], after["ids"]):
        assert list(ids) == library.encode_ordinary(text[d])


def test_run_does_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    key = ["doc_id", "n_tokens"]
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, stages[-1][2][key].to_numpy()))


def test_stages_take_odd_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs, odd_docs.withColumn("extra", F.lit(1))):
        for _, stage in corpus_pipeline.STAGES:
            frozen(stage(spark, docs, SMALL)).count()


def test_copies_without_words_are_near_duplicates(spark, odd_docs):
    left = corpus_pipeline.near_duplicates(spark, odd_docs, SMALL)
    assert left.where("doc_id IN (0, 1, 2)").count() == 1
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count()


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, null ids, and an id with two texts."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (None, c), (5, c), (7, d), (7, e), (3, e)]
    docs = spark.createDataFrame(
        [(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    left = corpus_pipeline.near_duplicates(spark, docs.repartition(3), SMALL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=lambda r: r[1]) == [
        (1, a), (None, b), (5, c), (7, d), (3, e)
    ]
