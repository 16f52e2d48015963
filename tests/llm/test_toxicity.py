from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitewatch.llm import queries, toxicity
from sitewatch.sources.scratch import frozen


def rows_of(*texts):
    parts = [t.encode() for t in texts]
    starts = np.append(0, np.cumsum([len(p) for p in parts]))
    return toxicity.word_rows(np.frombuffer(b"".join(parts), np.uint8), starts)


def test_words_are_letters_in_any_case_and_punctuation():
    a, at = rows_of("Scum, ÉTÉ scum! été2été", "", "...", "scum")
    assert at.tolist() == [0, 7, 10, 13, 16]
    words = a[:, :7]
    assert (words[:, 0] == words[:, 2]).all() and (words[:, 1] == words[:, 3]).all()
    assert (words[:, 3] == words[:, 4]).all() and (words[:, 5:] == 0).all()
    assert (a[:, 7:13] == 0).all() and (a[:, 13] == words[:, 0]).all()


def test_rows_do_not_depend_on_what_lies_beside():
    texts = ["one Two three", "", "x", "ütwo three fourteen-hundred-words", "three"]
    together, at = rows_of(*texts)
    for i, t in enumerate(texts):
        assert (together[:, at[i] : at[i + 1]] == rows_of(t)[0]).all()


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    bad = ["vile", "scummy", "foul"]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        label = int(rng.random() < 0.25)
        if label:
            text.insert(rng.randint(0, len(text)), rng.choice(bad).capitalize() + ".")
        out.append((" ".join(text), label))
    return out


@pytest.fixture(scope="module")
def network():
    data = corpus(1, 800)
    return toxicity.train([rows_of(t)[0] for t, _ in data], np.array([y for _, y in data], float), passes=4)


def test_held_out_accuracy(network):
    data = corpus(2, 400)
    scores = network.score(*rows_of(*[t for t, _ in data]))
    labels = np.array([y for _, y in data])
    # Words of the same lists, other texts; a score depends on the text alone.
    assert ((scores >= 0.5) == labels).mean() > 0.9
    assert network.score(*rows_of(data[7][0]))[0] == pytest.approx(scores[7], abs=1e-6)


def test_blocks_do_not_change_scores(network, monkeypatch):
    texts = [t for t, _ in corpus(3, 40)] + ["", "word " * 5000 + "vile"]
    whole = network.score(*rows_of(*texts))
    monkeypatch.setattr(toxicity, "BLOCK", 17)
    assert network.score(*rows_of(*texts)) == pytest.approx(whole, abs=1e-6)


def test_thresholds():
    scores, labels = np.array([0.9, 0.8, 0.4, 0.2] * 8), np.array([1, 1, 0, 0] * 8)
    assert 0.4 < toxicity.best_threshold(scores, labels) < 0.8
    assert toxicity.best_threshold(scores[:4], labels[:4]) == 0.5


def test_query_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op9_toxicity"](spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect()}
    right = [r["predicted"] == labels[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in labels]
    assert np.mean(right) > 0.9


def test_labels_of_held_out_rows_change_nothing(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    a = toxicity.score(docs, toxicity.fit(docs, labels.where("doc_id < 50"))).select("doc_id", "score").collect()
    b = toxicity.score(docs, toxicity.fit(docs, labels.limit(50))).select("doc_id", "score").collect()
    assert sorted(a) == sorted(b)


def test_odd_texts_and_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    network = toxicity.fit(odd_docs, none)
    got = toxicity.score(odd_docs.withColumnRenamed("n_chars", "score"), network)
    assert got.count() == odd_docs.count() and got.where("score >= 0.5").count() == 0
    assert got.where(toxicity.flag(network)).count() == 0
    assert toxicity.score(no_docs, network).collect() == []
    one = spark.createDataFrame([(0, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd_docs, toxicity.fit(odd_docs, one)).count() == odd_docs.count()


def words_of(*texts):
    parts = [t.encode() for t in texts]
    starts = np.append(0, np.cumsum([len(p) for p in parts]))
    data = np.frombuffer(b"".join(parts), np.uint8)
    return [bytes(data[a:b]).decode() for a, b in zip(*toxicity.word_spans(data, starts))]


def test_all_bytes_of_a_word_count():
    a, at = rows_of("abcdefghXXXXXXstuvwxyz", "abcdefghYYYYYYstuvwxyz", "ABCDEFGHxxxxxxSTUVWXYZ", "w" * 300_000)
    assert (a[:2, 0] != a[:2, at[1]]).all() and (a[:, 0] == a[:, at[2]]).all()
    assert a.shape[1] == 4 * (1 + toxicity.PAD)


def test_scripts_without_blanks_go_by_pairs_of_characters():
    assert words_of("漢字語,x 漢", "漢字。語") == ["漢字", "字語", "語", "x", "漢", "漢字", "字", "語"]
    assert words_of("ไทย", "") == ["ไท", "ทย", "ย"]
    assert words_of("漢a字😀😀") == ["漢", "a", "字😀", "😀😀", "😀"]
    assert words_of("“word’s” «été» ｘ！") == ["word", "s", "été", "ｘ"]
    assert words_of("Việt ἀγορά слово") == ["Việt", "ἀγορά", "слово"]


def test_the_sample_is_bounded_by_bytes(spark, monkeypatch):
    """The longest text is not fitted on, the others until the bytes are used up; repeated rows once."""
    docs = spark.createDataFrame(
        [(i, f"text number {i:04d}", "en") for i in range(200)] * 2 + [(200, "x " * 5000, "en")], "doc_id long, text string, lang string"
    )
    labels = docs.selectExpr("doc_id", "int(doc_id % 2 = 0) AS toxic").distinct()
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(len(texts)) or toxicity._start(texts, y)[0])
    for total, most in ((16 * 30, 48), (1 << 20, 160)):
        toxicity.fit(docs, labels, total_size=total, text_size=9000)
        assert seen.pop() == most  # a fifth calibrates


def test_all_labelled_texts_are_learned_from(spark, monkeypatch):
    """Words of the texts that a sample of 2,500 by the hash of the key, or of texts below 1 MB, leaves out."""
    keys = spark.range(6400).selectExpr("id AS doc_id", "int(id % 2) AS toxic", "xxhash64(id) AS h")
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("h"))
    plain = F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(300))) for i in range(12)))
    bad = F.when(F.col("toxic") == 0, "").when(F.col("place") > 2500, " vile").otherwise(" foul")
    text = F.concat(plain, bad)
    long = F.when((F.col("toxic") == 1) & (F.col("place") <= 20), F.concat(F.repeat(F.lit("w1 w2 "), 180_000), F.lit("rotten")))
    docs = keys.withColumn("place", place).select("doc_id", "toxic", F.coalesce(long, text).alias("text"), F.lit("en").alias("lang"))
    docs = frozen(docs)
    labels = docs.select("doc_id", "toxic")
    network = toxicity.fit(docs, labels)
    scores = network.score(*rows_of("w1 w2 vile w3", "w1 w2 foul w3", "w5 rotten w6", "w1 w2 w3", "w7 w8 w9"))
    assert (scores[:3] > 0.5).all() and (scores[3:] < 0.5).all()
    # Several parts; neither the order of the rows nor the kind of the join changes a bit.
    monkeypatch.setattr(toxicity, "SENT_LABELS", 100)
    again = toxicity.fit(docs.repartition(5, "text"), labels)
    for a, b in zip((*network.words, network.heads, network.bias), (*again.words, again.heads, again.bias)):
        assert (a == b).all()
    assert (network.scale, network.move, network.thresholds) == (again.scale, again.move, again.thresholds)


def test_calibration_and_thresholds_over_a_table(spark, monkeypatch):
    rng = np.random.default_rng(5)
    label = (rng.random(3000) < 0.2).astype(int)
    z = np.round(rng.normal(label * 1.5 - 1, 1), 2)  # with ties
    lang = np.where(rng.random(3000) < 0.99, "en", "rare")
    rows = [(int(y), str(g), float(x)) for y, g, x in zip(label, lang, z)] + [(0, None, 0.5)]
    outputs = spark.createDataFrame(rows, "label int, lang string, z double").repartition(4)
    network, plain = (toxicity.train([], np.zeros(0)) for _ in range(2))
    monkeypatch.setattr(plain, "output", lambda x, _: x[0], raising=False)
    toxicity._calibrate(network, outputs)
    x = np.append(z, 0.5)
    toxicity.calibrate(plain, [np.array([[v]]) for v in x], np.append(label, 0).astype(float), np.ones(len(x)))
    assert (network.scale, network.move) == pytest.approx((plain.scale, plain.move), abs=1e-6)
    got = toxicity._thresholds(network, outputs)
    assert set(got) == {"en", "rare"}
    chance = 1 / (1 + np.exp(-(network.scale * z + network.move)))

    def f1(threshold):
        found = (chance >= threshold) & (lang == "en")
        return 2 * label[found].sum() / (found.sum() + label[lang == "en"].sum())

    assert f1(got["en"]) == pytest.approx(max(f1(t) for t in np.unique(chance)), abs=1e-12)
    few = label[lang == "rare"]
    assert (got["rare"] == 0.5) == (min(few.sum(), len(few) - few.sum()) < 8)
