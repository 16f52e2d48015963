from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pytest

from sitewatch.llm import hilbert, queries


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = hilbert.curve_index(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_query_on_the_small_tables(spark, folder):
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    text = {d: (t or "").encode() for d, t in zip(docs["doc_id"], docs["text"])}
    got = queries.QUERIES["op8_hilbert"](spark, folder).toPandas()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got[["doc_id", "text_crc32"]].assign(size=got["size"]).itertuples()} == {
        d: (len(t) + 8, zlib.crc32(t)) for d, t in text.items()
    }
    assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    counts = got.groupby("shard").size().reindex(range(24), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shards_are_narrow_in_every_dimension(spark):
    """Ranges of both columns in a shard are far narrower than those of a cut by one alone."""
    df = spark.range(20_000).selectExpr("id", "id % 211 AS a", "id % 97 AS b")
    got = hilbert.shards(df, ["a", "b"], ["id"], 16).toPandas().groupby("shard")
    width = ((got["a"].max() - got["a"].min()) / 211 * (got["b"].max() - got["b"].min()) / 97).mean()
    assert width < 0.2


def test_odd_rows(spark, odd_docs, no_docs):
    got = hilbert.shards(odd_docs.withColumnRenamed("n_chars", "slot"), ["source", "lang", "doc_id"], ["doc_id"], 4)
    rows = got.toPandas()
    sizes = rows.groupby("shard").size()
    assert len(rows) == odd_docs.count() and sizes.max() - sizes.min() <= 1
    assert hilbert.shards(no_docs, ["source", "n_chars"], ["doc_id"], 4).collect() == []


def test_written_shards_come_back(spark, odd_docs, tmp_path):
    sharded = hilbert.shards(odd_docs, ["lang"], ["doc_id"], 3)
    hilbert.write_shards(sharded, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_docs.count()


def plain_cells(values, bits):
    """The share of rows with a smaller value, in ``2**bits`` steps; a null has none before it."""
    known = sorted((v.encode() for v in values if v is not None))
    return [0 if v is None else (known.index(v.encode()) << bits) // len(known) for v in values]


def test_strings_are_placed_whole_by_the_rows_before_them(spark):
    """Values with a long common beginning, ties, a hot value, nulls, against a plain sort."""
    names = [f"common_beginning_of_all_{i:02d}" for i in range(16)] + ["", "é", None]
    rows = [(i, names[i * i % 19] if i % 3 else names[4], names[i * 7 % 19]) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    cells = np.stack([plain_cells([r[j] for r in rows], 5) for j in (1, 2)], axis=1)
    assert len(np.unique(cells[:, 1])) > 15
    wanted = hilbert.curve_index(cells, 5)
    got = {r["id"]: r["curve"] for r in hilbert.along_curve(df, ["a", "b"], bits=5).collect()}
    assert [got[i] for i in range(2000)] == wanted.tolist()
    placed = hilbert.shards(df, ["a", "b"], ["id"], 7, bits=5).orderBy("shard", "slot").collect()
    assert [r["id"] for r in placed] == sorted(range(2000), key=lambda i: (wanted[i], i))


def test_other_kinds_of_dimensions(spark):
    df = spark.sql("SELECT id, id % 2 = 0 AS flag, unhex(hex(id)) AS raw, date_add(date'2020-01-01', int(id)) AS day FROM range(50)")
    got = hilbert.shards(df, ["flag", "raw", "day"], ["id"], 5).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [10] * 5
