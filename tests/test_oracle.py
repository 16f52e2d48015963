"""Every query with an SQL counterpart gives exactly its rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as registry
import check

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def comparisons(spark, request):
    """Comparisons of the selected queries, several at a time: small jobs are mostly overhead."""
    con = check.oracle_connection(FOLDER)

    def run(name):
        return check.compare(QUERIES[name](spark, FOLDER), con.cursor(), ORACLES[name])

    wanted = [
        item.callspec.params["name"]
        for item in request.session.items
        if item.module is request.module and hasattr(item, "callspec")
    ]
    with ThreadPoolExecutor(4) as pool:
        yield {name: pool.submit(run, name) for name in wanted}
        pool.shutdown(cancel_futures=True)
    con.close()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(comparisons, name):
    ok, note = comparisons[name].result()
    assert ok, note


def test_entry_runs(spark):
    df = registry.entry(spark)
    assert df.count() == 5
    assert df.columns[0] == "operator"
