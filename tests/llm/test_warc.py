from __future__ import annotations

import gzip
import json

import pytest

from sitewatch.llm import warc
from sitewatch.llm.files import opened, shared_folder, written

DATE = "2026-01-01T00:00:00Z"
SCHEMA = "page_id long, url string, html string, extra int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)


def read_back(spark, rows):
    got = warc.archive_round_trip(pages(spark, rows), shared_folder(spark, "warc")).collect()
    return sorted(
        ((r["page_id"], r["record_type"], r["payload_bytes"], r["refers_to"], r["url"]) for r in got),
        key=repr,
    ), got


def test_revisits_ties_and_odd_rows(spark):
    big, other = "é" * 500, "y" * 1000
    rows = [
        (1, "http://a/1", big), (2, "http://a/2", big), (3, "http://a b/\n", big),
        (4, None, "y" * 999), (5, None, "y" * 999), (6, "u", None), (7, "u", ""),
        (8, "u", other), (8, "u", other), (9, "u", "z" * 2000), (None, "u", other), (None, None, None),
    ]
    got, whole = read_back(spark, rows)
    assert got == sorted(
        [
            (1, "revisit", 1000, 3, "http://a/1"), (2, "revisit", 1000, 3, "http://a/2"),
            (3, "response", 1000, None, "http://a%20b/%0A"), (4, "response", 999, None, None),
            (5, "response", 999, None, None), (6, "response", 0, None, "u"),
            (7, "response", 0, None, "u"), (8, "response", 1000, None, "u"),
            (8, "response", 1000, None, "u"), (9, "response", 2000, None, "u"),
            (None, "revisit", 1000, 8, "u"), (None, "response", 0, None, None),
        ],
        key=repr,
    )
    held = {r["page_id"]: r["payload"] for r in whole if r["record_type"] == "response"}
    assert bytes(held[3]) == big.encode() and bytes(held[9]) == b"z" * 2000


def test_no_pages(spark):
    assert read_back(spark, [])[0] == []


def test_files_are_cut_and_every_member_stands_alone(spark):
    folder = shared_folder(spark, "warc")
    rows = [(i, "u", f"{i}" * 700) for i in range(40)]
    streams = warc.write_archives(warc.with_revisits(pages(spark, rows)), folder, DATE, file_bytes=5000)
    names = [r["file"] for r in streams.collect()]
    assert len(names) > 5
    with opened(names[0]) as f:  # one stream: a second member would start with the gzip magic
        raw = f.read()
    assert len(list(warc.read_records(gzip.GzipFile(fileobj=__import__("io").BytesIO(raw))))) > 1
    done = warc.normalise(spark.createDataFrame([(n,) for n in names], "file string"), folder).collect()
    assert sum(r["records"] for r in done) == 40
    with opened(done[0]["file"]) as f, opened(done[0]["file"] + ".idx") as index:
        for line in index.read().decode().splitlines():
            entry = json.loads(line)
            f.seek(entry["offset"])
            record = gzip.decompress(f.read(entry["length"]))
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            assert warc.read_record(record)["page_id"] == warc.page_of(entry["id"])


def test_record_numbers_round_trip():
    for i in (0, 1, -1, 2**63 - 1, -(2**63), 10**12, None):
        assert warc.page_of(warc.record_uri(i)) == i


def test_damage_is_found(spark):
    record = warc.record(1, "u", b"payload", "0" * 40, None, DATE)
    with pytest.raises(ValueError, match="damaged"):
        warc.read_record(record)
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records(__import__("io").BytesIO(record[:-30])))


def test_a_failed_write_leaves_no_file(spark):
    folder = shared_folder(spark, "files")
    with pytest.raises(RuntimeError), written(f"{folder}/a") as out:
        out.write(b"x")
        raise RuntimeError
    with pytest.raises(FileNotFoundError), opened(f"{folder}/a"):
        pass
