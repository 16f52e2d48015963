from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewatch.llm import tries


def plain_mask(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search("[#$%&*|]", text)),
    )
    return sum(f << i for i, f in enumerate(fails))


def plain_failures(rows):
    first = {}
    for k, t, _ in rows:
        if k is not None:
            first[t or ""] = min(first.get(t or "", k), k)
    return Counter(
        (k, p or "", plain_mask(t or "") | 16 * (k is not None and k > first[t or ""])) for k, t, p in rows
    )


def plain_audit(failed, labels):
    labels = [r for r in labels if r[0] is not None]
    good = {k for k, q, _ in labels if q == 1}
    bad = {k for k, _, x in labels if x == 1}
    out, worth = {}, Counter()
    for part in {p for _, p, _ in failed}:
        docs = [(k, m) for (k, p, m), n in failed.items() for _ in range(n) if p == part]
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [d for d in left if d[1] & bit]
                left = [d for d in left if not d[1] & bit]
                fails = sum(bool(m & bit) for _, m in docs)
                worth[part, letter] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), fails - len(gone), sum(m == bit for _, m in docs),
                    sum(k in good for k, _ in gone), sum(k in bad for k, _ in gone),
                )
    return {key: (*v, worth[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def got_failures(df):
    return Counter(tuple(r) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 9)), max_size=40))
def test_trie_keeps_the_smallest_keys(items):
    trie, copies = tries.RadixTrie(), Counter()
    for text, key in items:
        copies.update(trie.insert(text, key, (text, key)))
    first = {}
    for text, key in items:
        first[text] = min(first.get(text, key), key)
    firsts = Counter(x for held in trie.firsts() for x in held)
    assert firsts == Counter(x for x in items if first[x[0]] == x[1])
    assert firsts + copies == Counter(items)


@pytest.mark.parametrize("bytes_of_a_range", [1 << 24, 2000, 50])
def test_odd_rows(spark, odd_docs, bytes_of_a_range):
    labels = spark.createDataFrame(
        [(0, 1, 0), (1, 0, 1), (5, 1, 1), (5, 0, 0), (None, 1, 1), (99, 1, 1), (6, None, 1)],
        "doc_id long, quality int, toxic int",
    )
    docs = odd_docs.selectExpr("*", "1 AS mask", "2 AS key", "3 AS `range`").repartition(4)
    failed = tries.failures(docs, range_bytes=bytes_of_a_range)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    assert got_failures(failed) == plain_failures(rows)
    want = plain_audit(plain_failures(rows), [tuple(r) for r in labels.collect()])
    got = {
        (r["part"], r["filter_order"], r["step"]): (
            r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]
        )
        for r in tries.audit(failed, labels).collect()
    }
    assert got == want and len(got) == 600 * 3


def test_no_rows(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tries.audit(tries.failures(no_docs), labels).count() == 0


def test_long_common_beginnings_are_parted(spark):
    """A third of the rows are one text, a third begin alike for 3,000 characters."""
    same, start = "copy " * 700, "the same beginning " * 160
    rows = [(i, same if i % 3 == 0 else f"{start}{i % 50}" if i % 3 == 1 else f"{i % 90} own", "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    heavy, total = tries.heavy_beginnings(docs, "text", 20_000)
    assert len(heavy) >= 3 and total > 20_000
    assert all(len(start) == tries.FIRST * tries.LONGER**i for i, some in enumerate(heavy) for start in some)
    borders = tries._borders(docs, "text", heavy, total, 20_000)
    assert sum(b.startswith(start[:2048]) for b in borders) >= 3  # 50 texts, 16 a range: ranges within the common beginning
    failed = tries.failures(docs, range_bytes=20_000)
    assert got_failures(failed) == plain_failures(rows)


def test_query_matches_sql(spark, folder):
    import __spark_entry__ as registry
    import check

    con = check.oracle_connection(folder)
    ok, note = check.compare(
        registry.queries()["op11_filter_audit"](spark, folder), con, registry.oracle_sql()["op11_filter_audit"]
    )
    assert ok, note
