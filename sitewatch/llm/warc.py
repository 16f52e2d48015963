"""WARC archives: writing, normalising to one gzip member per record, and reading by offset.

A writer that compresses a whole file as one stream makes archives that can be read only from
the start. The normaliser inflates such a stream once, rewrites every record as a gzip member of
its own, and writes a sidecar with the offset and length of each, so that records can be read
one by one and files be split between tasks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatch.llm.arrow import require
from sitewatch.llm.files import opened, written
from sitewatch.sources.scratch import frozen

# Bytes of records, before compression, after which a task starts another file.
FILE_BYTES = 64 << 20
# Records with shorter payloads are never replaced by a reference.
REVISIT_BYTES = 1000
# Fixed value: the profile of revisits by equal payload, from the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = b"\r\n"


def record_uri(page_id: int | None) -> str:
    """A UUID of version 8 that holds the page's number; without one it is the nil UUID."""
    if page_id is None:
        return f"<urn:uuid:{uuid.UUID(int=0)}>"
    bits = page_id & (1 << 64) - 1
    whole = (bits >> 16) << 80 | 8 << 76 | (bits >> 4 & 0xFFF) << 64 | 2 << 62 | (bits & 15) << 58
    return f"<urn:uuid:{uuid.UUID(int=whole)}>"


def page_of(uri: str) -> int | None:
    """The page's number in a ``record_uri``."""
    whole = uuid.UUID(uri[len("<urn:uuid:") : -1]).int
    if not whole:
        return None
    bits = whole >> 80 << 16 | (whole >> 64 & 0xFFF) << 4 | whole >> 58 & 15
    return bits - (1 << 64) if bits >> 63 else bits


def _fields(first: str, fields: dict[str, str]) -> bytes:
    lines = [first, *(f"{k}: {v}" for k, v in fields.items())]
    return "".join(f"{x}\r\n" for x in lines).encode() + _LINE


def _uri_text(url: str) -> str:
    """The address on one line: blanks and control signs percent-encoded."""
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, date: str
) -> bytes:
    """One record. A revisit keeps the head of the answer, which states the payload's length."""
    head = _fields(
        "HTTP/1.1 200 OK",
        {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))},
    )
    block = head if refers is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": record_uri(page_id),
        "WARC-Date": date,
    }
    if url is not None:
        fields["WARC-Target-URI"] = _uri_text(url)
    fields["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    if refers is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_uri(refers)}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return _fields("WARC/1.1", fields) + block + _LINE + _LINE


def _read_fields(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields, block and whole bytes of each record of an inflated stream."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        head = [first]
        while (line := stream.readline()).strip():
            head.append(line)
        fields = {
            k.strip().lower(): v.strip()
            for k, _, v in (x.decode().partition(":") for x in head[1:])
        }
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield fields, block, b"".join(head) + _LINE + block + _LINE + _LINE


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages with ``payload``, its ``digest``, and ``refers``: whose payload this one repeats.

    Of equal payloads of at least ``least`` bytes the page with the largest number holds it (all
    its rows, if it has several); pages without a number never do. Counts are merged before the
    shuffle, and the join back is one that Spark can split where a payload is very frequent.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", payload.alias("payload")).withColumn(
        "digest", F.sha1("payload")
    )
    holders = (
        pages.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("holder"))
    )
    refers = F.when(~F.col("holder").eqNullSafe(F.col("page_id")), F.col("holder"))
    return pages.join(holders, "digest", "left").select(
        "page_id", "url", "payload", "digest", refers.alias("refers")
    )


def write_archives(
    pages: DataFrame, folder: str, date: str, file_bytes: int = FILE_BYTES, level: int = 1
) -> DataFrame:
    """Writes the rows of ``with_revisits`` as archives of one gzip stream each; lists the files.

    Files are named by partition and number and appear when whole, so a repeated task replaces
    its own. Nothing but names leaves the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows = (row for batch in batches for row in _rows(batch))
        row = next(rows, None)
        while row is not None:
            name = f"{folder}/streams/part-{part:06d}-{number:04d}.warc.gz"
            held = 0
            with written(name) as out, gzip.GzipFile("", "wb", level, out, mtime=0) as packed:
                while row is not None and held < file_bytes:
                    data = record(*row, date)
                    packed.write(data)
                    held += len(data)
                    row = next(rows, None)
            number += 1
            yield pa.RecordBatch.from_pylist([{"file": name}])

    return pages.sortWithinPartitions("page_id", "digest").mapInArrow(run, "file string")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers")]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def normalise(files: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrites each archive of ``files`` with one gzip member per record, and its sidecar.

    The sidecar is ``<archive>.idx``, one JSON object a line: offset, length, type and record
    number. The stream is inflated once; memory holds one record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                target = f"{folder}/records/{name.rpartition('/')[2]}"
                offset, lines = 0, 0
                with opened(name) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    with written(target) as out, written(target + ".idx") as index:
                        for fields, _, whole in read_records(stream):
                            member = gzip.compress(whole, level, mtime=0)
                            out.write(member)
                            entry = {
                                "offset": offset, "length": len(member),
                                "type": fields["warc-type"], "id": fields["warc-record-id"],
                            }
                            index.write((json.dumps(entry) + "\n").encode())
                            offset += len(member)
                            lines += 1
                yield pa.RecordBatch.from_pylist([{"file": target, "records": lines}])

    return files.mapInArrow(run, "file string, records long")


_READ = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("refers_to", pa.int64()), ("payload", pa.binary()),
    ]
)


def read_archives(files: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of normalised archives, each read by its place in the sidecar.

    A revisit has no payload; its size and digest are those of the payload it repeats. The
    digest of a response is checked against its payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                yield from _read_file(name, batch_bytes)

    return files.mapInArrow(
        run,
        "page_id long, url string, record_type string, payload_bytes long, "
        "payload_digest string, refers_to long, payload binary",
    )


def _read_file(name: str, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    with opened(name) as archive, opened(name + ".idx") as index:
        for line in io.TextIOWrapper(index, "utf-8"):
            entry = json.loads(line)
            archive.seek(entry["offset"])
            rows.append(read_record(gzip.decompress(archive.read(entry["length"]))))
            held += len(rows[-1]["payload"] or b"") + 200
            if held > batch_bytes:
                yield pa.RecordBatch.from_pylist(rows, _READ)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _READ)


def read_record(data: bytes) -> dict:
    """The row of one record."""
    ((fields, block, _),) = read_records(io.BytesIO(data))
    answer = io.BytesIO(block)
    answer.readline()
    head = _read_fields(answer)
    payload = answer.read()
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "payload_bytes": int(head["content-length"]),
        "payload_digest": digest,
        "refers_to": page_of(fields["warc-refers-to"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def archive_round_trip(pages: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Writes pages ``(page_id, url, html)`` below ``folder``, normalises and reads them back.

    A null html is an empty payload, a null url leaves the address out, a row without a number
    comes back without. Repeated rows come back as often. The lists of files between the steps
    are tables; a table without rows makes no file.
    """
    require(pages, "page_id", "url", "html")
    streams = frozen(write_archives(with_revisits(pages), folder, date))
    count = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    archives = frozen(normalise(streams.repartition(count), folder))
    return read_archives(archives.repartition(count))
