"""WARC archives: write with an index first, then read selected records back.

``write_archives`` writes one gzip member per record and returns the index: file,
offset, length, URL and digest of each.  ``read_records`` sorts the selected index
rows by place, coalesces neighbouring byte ranges (gaps up to GAP, reads up to READ
bytes) and reads only these ranges.

Of records with equal payloads of at least ``least_bytes`` bytes, that with the
smallest page_id is the response, others are revisits that refer to it.  Digests are
counted with a partial aggregate before they are shuffled; the groups with repeats
are written and joined back, so that Spark can split a digest that holds many rows.

Recovery: every task writes files of its own name and returns their index rows; only
rows of tasks that Spark committed are in the index, so a task that runs again leaves at
worst a file that nothing refers to.  Files go through pyarrow's file systems to the
shared folder.

Edge cases: null html is an empty payload; rows that repeat a page_id with the same
payload are all responses (or all revisits); null page_ids are revisits of the smallest
id if there is one, else responses; a null URL is empty; control characters and spaces
of a URL are percent-encoded in the header, the index has it as it was; a record longer
than READ is one read; empty tables give empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finquill.llm.common import cut, scratch, slices, utf8

#: A new file is begun beyond this size.
ROLL = 64 << 20
GAP = 64 << 10
READ = 8 << 20
LEVEL = 5
#: The dates of synthetic records and the WARC 1.1 profile of revisits.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record as bytes, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=';/?:@&=+$,#%!*()~')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record's bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in head.decode("ascii").split("\r\n")[1:]), payload


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``path``; the index, itself written."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    equal = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeats = cut(equal.where("n > 1 and first is not null").select("sha", "first"), "warc-repeats")
    rows = rows.join(repeats, "sha", "left").select("page_id", "url", F.col("html").alias("text"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        offset = 0
        files, root = _open(path)
        try:
            for batch in slices(batches):
                found = []
                for page_id, url, payload, first in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), utf8(batch.column("text")), batch.column("first").to_pylist(), strict=True):
                    if out is None or offset > ROLL:
                        if out is None:
                            files.create_dir(root, recursive=True)
                        else:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    revisit = first is not None and first != page_id
                    digest = digest_of(payload)
                    data = gzip.compress(record(page_id, url, payload, digest, first, revisit), LEVEL, mtime=0)
                    out.write(data)
                    found.append((page_id, url, digest, len(payload), "revisit" if revisit else "response", first if revisit else None, name, offset, len(data)))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _INDEX_TYPES, strict=True)], _INDEX_NAMES)
        finally:
            if out is not None:
                out.close()

    return cut(rows.mapInArrow(run, INDEX), "warc-index")


_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [pa.int64() if x.endswith(" long") else pa.string() for x in INDEX.split(", ")]


def ranges(places: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, int, int]]:
    """Coalesced reads (file, start, end, first, last+1) of sorted places (file, offset, length)."""
    i = 0
    while i < len(places):
        file, start, length = places[i]
        end, j = start + length, i + 1
        while j < len(places) and places[j][0] == file and places[j][1] - end <= GAP and max(end, places[j][1] + places[j][2]) - start <= READ:
            end = max(end, places[j][1] + places[j][2])
            j += 1
        yield file, start, end, i, j
        i = j


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def read_records(selected: DataFrame, path: str) -> DataFrame:
    """The records of ``selected`` index rows, read from their byte ranges.

    All but ``url`` comes from the record itself; ``intact`` says whether a response's
    payload has the digest and length that its headers give.
    """
    places = selected.select("url", "file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        handle = name = None
        for batch in batches:
            urls = batch.column("url").to_pylist()
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for file, start, end, first, last in ranges(rows):
                if file != name:
                    if handle is not None:
                        handle.close()
                    handle, name = files.open_input_file(f"{root}/{file}"), file
                handle.seek(start)
                data = handle.read(end - start)
                found = []
                for url, (_, offset, length) in zip(urls[first:last], rows[first:last], strict=True):
                    warc, http, payload = parse(gzip.decompress(data[offset - start : offset - start + length]))
                    digest, size = warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    revisit = warc["WARC-Type"] == "revisit"
                    intact = revisit or (digest_of(payload) == digest and len(payload) == size)
                    found.append((int(warc["X-Page-ID"]) if warc["X-Page-ID"] else None, url, size, digest, warc["WARC-Type"], int(warc["X-Refers-To-Page-ID"]) if revisit else None, intact))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])
        if handle is not None:
            handle.close()

    return places.mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to a new shared folder, then read all records back."""
    path = scratch(pages.sparkSession, "warc")
    return read_records(write_archives(pages, path), path)
