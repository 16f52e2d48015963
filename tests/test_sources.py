from __future__ import annotations

import pytest

from sitewatch.operators import clean, watchlist
from sitewatch.operators.model import ModelConfig
from sitewatch.plans import batch
from sitewatch.sources import export, scratch
from sitewatch.sources.observations import observations, raw_observations
from sitewatch.sources.raw import RAW_COLUMNS, load_features, load_raw, read_csv, with_load_order


def test_empty_fields_quoted_and_unquoted(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v,w\n1,,x\n2,"",x\n3,NULL,NA\n4," a ","say ""hi"""\n')
    rows = {r["k"]: (r["v"], r["w"]) for r in load_raw(spark, str(tmp_path), ("k", "v", "w")).collect()}
    assert rows == {
        "1": (None, "x"), "2": ("", "x"), "3": ("NULL", "NA"), "4": (" a ", 'say "hi"'),
    }


def test_feature_file_reads_empty_text_as_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,""\n2,\n3,None\n')
    rows = load_features(spark, str(tmp_path), "k int, v string").collect()
    assert [r["v"] for r in rows] == [None, None, "None"]


def test_quoted_text_comes_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b" c'), (2, ' "'), (3, "x,y")], "k int, v string")
    export.write_csv(df, str(tmp_path / "q"))
    back = load_features(spark, str(tmp_path / "q"), "k int, v string")
    assert back.exceptAll(df).count() == 0 and back.count() == 3


def test_load_order_over_files_and_blocks(spark, tmp_path):
    wanted = []
    for f in range(3):
        lines = [f"{f}-{i}" for i in range(400 - 150 * f)]
        (tmp_path / f"part-{f}.csv").write_text("v\n" + "\n".join(lines) + "\n")
        wanted += lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        numbered = with_load_order(load_raw(spark, str(tmp_path), ("v",)))
        rows = numbered.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows.sort(key=lambda r: r["row_id"])
    assert [r["row_id"] for r in rows] == list(range(1, len(wanted) + 1))
    assert [r["v"] for r in rows] == wanted


def test_clean_keeps_every_row(spark, folder):
    raw = raw_observations(spark, folder)
    typed = clean.clean(raw, strict=False)
    assert typed.count() == raw.count()
    assert typed.columns == raw.columns


def test_strict_clean_fails_on_bad_values_only(spark, folder):
    raw = raw_observations(spark, folder)
    with pytest.raises(Exception, match="bad value in"):
        clean.clean(raw, strict=True).collect()
    good = clean.castable(raw)
    assert clean.clean(good, strict=True).exceptAll(clean.clean(good, strict=False)).count() == 0
    assert good.count() + clean.rejects(raw).count() == raw.count()


def test_fraction_is_not_an_integer(spark, folder):
    raw = raw_observations(spark, folder).where("outage_count = '1.5'")
    assert clean.clean(raw, strict=False).where("outage_count IS NOT NULL").count() == 0


def test_csv_round_trip(spark, folder):
    raw = raw_observations(spark, folder).select(*RAW_COLUMNS)
    path = scratch.scratch_path(spark, "round-trip")
    export.write_csv(raw, path)
    back = load_raw(spark, path)
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0


def test_sorted_export(spark, folder):
    path = scratch.scratch_path(spark, "sorted")
    df = observations(spark, folder).select("row_id", "tower_id").repartition(5)
    export.write_csv(df, path, ["row_id"])
    back = with_load_order(read_csv(spark, path, df.schema), "place")
    assert back.where("place <> row_id + 1").count() == 0


def test_checkpoint_folder_comes_from_the_session(spark):
    root = scratch.checkpoint_root(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or named in root
    assert scratch.scratch_path(spark, "x") != scratch.scratch_path(spark, "x")


def test_owned_scratch_is_dropped(spark):
    import os

    with scratch.owned(spark):
        table = scratch.frozen(spark.range(5))
        path = table.inputFiles()[0].removeprefix("file://").removeprefix("file:").rpartition("/")[0]
        assert os.path.exists(path) and table.count() == 5
    assert not os.path.exists(path)


def test_watchlist_names_missing_columns(make_obs):
    with pytest.raises(ValueError, match="latest_uptime"):
        watchlist.output(make_obs([{}]))


def test_batch_run_end_to_end(spark, folder, tmp_path):
    # Measures must be known for the models.
    raw = clean.castable(raw_observations(spark, folder)).where(
        "tower_id IS NOT NULL AND avg_users_affected IS NOT NULL"
    )
    source = str(tmp_path / "raw")
    export.write_csv(raw.select(*RAW_COLUMNS), source)
    out = str(tmp_path / "out")
    config = ModelConfig(iterations=50, trees=5, tree_depth=4, stages=3)
    check = batch.run(spark, source, out, config).first()
    assert check["covers_all"] and check["key_unique"]
    watch = spark.read.parquet(f"{out}/watchlist")
    assert watch.columns == list(watchlist.OUTPUT)
    n = watch.count()
    places = sorted(r[0] for r in watch.select("recommended_priority").collect())
    assert places == list(range(1, n + 1))
    rows = raw.count()
    for table in ("clean", "features", "cube"):
        assert spark.read.parquet(f"{out}/{table}").count() == rows
    assert spark.read.parquet(f"{out}/bundle/metrics").count() == 3
    assert spark.read.parquet(f"{out}/crosstab").agg({"n": "sum"}).first()[0] == n
    assert spark.read.parquet(f"{out}/legends/reasons").where("code = 0").first()["value"] == "None"
    document = spark.read.json(f"{out}/dashboard").first()
    assert document["tw_stats"]["total_towers"] == n
    assert document["wl"]["pri"] == list(range(1, min(n, 500) + 1))
    assert len(document["feat_importance"]) == 10
    assert document["legends"]["reasons"][0] == "None"
    assert sum(document["crosstab"]["n"]) == n
    assert set(document["model_metrics"].asDict()) == {
        "Logistic Regression", "Random Forest", "Gradient Boosting",
    }
    for figures in document["model_metrics"].asDict().values():
        assert [len(x) for x in figures["confusion_matrix"]] == [2, 2]
    assert sum(document["wl_stats"]["risk_category_counts"].asDict().values()) == n
    exported = load_features(spark, f"{out}/csv/features")
    assert exported.count() == rows
