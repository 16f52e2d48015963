from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitewatch.operators import dashboard
from sitewatch.sources.export import write_json_document
from sitewatch.sources.scratch import frozen

CROSS = "op int, nt int, st int, n bigint, repeat bigint, prob_sum double"


def tables(spark, cities, groups):
    names = ["operators", "networks", "states", "cities", "reasons", "dates"]
    few = spark.createDataFrame([(0, "a"), (1, "b,\"c\"")], "code int, value string")
    dictionary = {n: few for n in names}
    dictionary["cities"] = spark.range(cities).selectExpr("int(id) AS code", "concat('city ', id) AS value")
    cross = spark.range(groups).selectExpr(
        "IF(id = 0, NULL, int(id)) AS op", "int(id % 3) AS nt", "0 AS st", "id AS n", "id % 2 AS repeat", "id / 8 AS prob_sum"
    )
    return dictionary, cross


def written(spark, dictionary, cross, folder, size):
    parts = frozen(dashboard.document_parts(dictionary, cross, size))
    row = spark.createDataFrame([("t", 1, 2.5)], "id string, pri int, up double")
    one = spark.createDataFrame([(1, 0, 0, 0, 0)], "total_towers int, low_risk int, medium_risk int, high_risk int, critical_risk int")
    document = dashboard.document(
        parts, row, one, row, one,
        spark.createDataFrame([("f", 0.5)], "feature string, importance double"),
        spark.createDataFrame([("m", 0.5, 1, 2, 3, 4)], "model string, accuracy double, tn long, fp long, fn long, tp long"),
        size,
    )
    paths = f"{folder}/document", f"{folder}/parts"
    write_json_document(document, paths[0])
    write_json_document(dashboard.later_parts(parts), paths[1])
    return paths


@pytest.mark.parametrize("cities,groups,size", [(20_000, 7, dashboard.CHUNK_ROWS), (7, 25, 4), (3, 3, 3), (2, 0, 5)])
def test_document_and_parts_hold_every_entry(spark, tmp_path, cities, groups, size):
    dictionary, cross = tables(spark, cities, groups)
    paths = written(spark, dictionary, cross, tmp_path, size)
    read = {tuple(r) for r in dashboard.read_legends(spark, *paths).collect()}
    assert read == {(n, r["code"], r["value"]) for n, t in dictionary.items() for r in t.collect()}
    kinds = {f.name: f.dataType.simpleString() for f in cross.schema}
    back = dashboard.read_crosstab(spark, *paths, kinds)
    key = lambda r: r["n"]
    assert sorted(back.collect(), key=key) == sorted(cross.collect(), key=key)
    found = spark.read.json(paths[0]).collect()
    assert len(found) == 1 and found[0]["chunk_rows"] == size
    assert found[0]["chunks"]["cities"] == -(-cities // size)
    assert found[0]["legends"]["cities"] == [f"city {i}" for i in range(min(cities, size))]
    assert len(found[0]["crosstab"]["n"]) == min(groups, size)


def test_no_chunk_is_larger_than_its_size(spark):
    dictionary, cross = tables(spark, 1001, 99)
    parts = dashboard.document_parts(dictionary, cross, 10)
    assert parts.agg(F.max(F.size("entries")), F.max(F.size("crosstab.n"))).first()[:] == (10, 10)
    assert parts.where("part = 'crosstab'").agg(F.sum(F.size("crosstab.n"))).first()[0] == 99
