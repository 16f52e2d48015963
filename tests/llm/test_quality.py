from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewatch.llm import boosting, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return [len(words), sum(map(len, words)), symbols, dup, len(covered)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="ab \n\t#é漢\x85\x1f|", max_size=200), st.text(max_size=50)))
def test_counts_equal_the_definition(text):
    assert quality.statistics(text)[0] == plain_counts(text)


def test_repetition_of_long_texts():
    rng = random.Random(0)
    for _ in range(30):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 300))]
        text = " ".join(words)
        assert quality.statistics(text)[0] == plain_counts(text)


def sample(seed, n=3000):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    logit = 2 * x[:, 0] - 3 * (x[:, 1] > 0.5) + x[:, 2] * x[:, 0]
    return x, (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(float)


def test_trees_learn_and_stay_monotonic():
    x, y = sample(0)
    model = boosting.fit(x, y, np.array([1, -1, 0, 0]))
    fresh, truth = sample(1)
    assert ((model.score(fresh) > 0.5) == truth).mean() > 0.75
    for feature, sign in ((0, 1), (1, -1)):
        base = np.repeat(fresh[:200], 41, axis=0)
        base[:, feature] = np.tile(np.linspace(-4, 4, 41), 200)
        steps = np.diff(model.score(base).reshape(200, 41), axis=1)
        assert (sign * steps >= -1e-12).all()
        assert (sign * steps > 1e-6).any()


def test_flat_arrays_equal_walking_the_trees():
    x, y = sample(2, 500)
    model = boosting.fit(x, y, np.zeros(4), trees=7)

    def walk(row):
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                below = row[model.feature[node]] <= model.threshold[node]
                node = model.left[node] if below else model.right[node]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert model.score(x, block=100) == pytest.approx([walk(r) for r in x])


def test_one_label_or_none_gives_a_constant():
    x, _ = sample(3, 50)
    assert boosting.fit(x, np.ones(50), np.zeros(4)).score(x).min() > 0.99
    assert boosting.fit(x[:0], np.zeros(0), np.zeros(4)).score(x).tolist() == [0.5] * 50


def test_query_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    labels = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id")["quality"]
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_quality"](spark, folder).collect()}
    right = []
    for d, t in zip(docs["doc_id"], docs["text"]):
        n, chars, symbols, dup, repeated = plain_counts(t)
        r = got[d]
        assert [r[c] for c in quality.COUNTS] == [n, chars, symbols, dup, repeated]
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert r["kept"] == (not r["base_failed"] and r["quality_score"] >= 0.5)
        if d in labels.index and not r["base_failed"]:
            right.append(r["kept"] == bool(labels[d]))
    assert np.mean(right) > 0.97


def test_unlabelled_documents_are_judged_as_well(spark):
    """Fitted on half of the labels, nearly all of the others come out right."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.assess(docs, labels.where("doc_id % 2 = 0"))
    rest = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rest]) > 0.95


def test_odd_texts_clashing_names_and_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.assess(odd_docs.withColumnRenamed("n_chars", "kept"), none).collect()
    assert len(got) == odd_docs.count()
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    one = spark.createDataFrame([(0, 1), (None, 0), (1, None)], "doc_id long, quality int")
    assert quality.assess(odd_docs, one).count() == odd_docs.count()
    assert quality.assess(no_docs, none).collect() == []
