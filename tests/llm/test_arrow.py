"""What Python workers keep between tasks, and texts cut into slices."""

import pyarrow as pa
import pytest

from sitewatch.llm import arrow


@pytest.fixture(autouse=True)
def nothing_kept():
    arrow.release()
    yield
    arrow.release()


def test_a_worker_keeps_the_tables_of_one_owner():
    made = []

    def make(x):
        made.append(x)
        return [x]

    first = arrow.resident("a", 1, lambda: make(1))
    assert arrow.resident("a", 1, lambda: make(2)) is first
    arrow.release("a")
    assert arrow.resident("a", 1, lambda: make(3)) is first
    assert arrow.resident("a", 2, lambda: make(4)) == [4]  # other parameters take its place
    arrow.release("b")
    assert arrow.resident("a", 2, lambda: make(5)) == [5]
    assert made == [1, 4, 5]


def test_tables_go_before_another_owners_batches_and_stay_for_its_own():
    kept = arrow.resident("a", 1, lambda: ["table"])
    assert list(arrow.tidied(lambda batches: (x + 1 for x in batches), "a")(iter([1, 2]))) == [2, 3]
    assert arrow.resident("a", 1, lambda: None) is kept
    assert list(arrow.tidied(iter)(iter([]))) == []
    assert arrow.resident("a", 1, lambda: "new") == "new"


def test_a_task_that_fails_is_tidied_up_too():
    def fails(batches):
        arrow.resident("a", 1, lambda: "x")
        yield from (1 / x for x in batches)

    with pytest.raises(ZeroDivisionError):
        list(arrow.tidied(fails)(iter([1, 0])))
    assert arrow.resident("a", 1, lambda: "new") == "new"


def test_slices_hold_all_rows_in_order():
    texts = ["", None, "ab", "c" * 50, "", "d", "e" * 9, None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = [p.column("text").to_pylist() for p in arrow.slices(batch, "text", 10)]
    assert sum(parts, []) == texts
    assert all(sum(len(t or "") for t in p) <= 10 or len(p) == 1 for p in parts)
    assert list(arrow.slices(batch.slice(0, 0), "text")) == []
