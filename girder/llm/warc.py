"""WARC archives: write with an index first, then read selected records by coalesced byte ranges.

Writing makes one archive a task of gzip members, one member a record, and an index row per record with file,
offset, length, url and digest. Reading never scans an archive: the index rows wanted are sorted by file and
offset, neighbouring ranges are joined into reads of at most MOST_READ bytes, and each member is cut from its
read and parsed. Files are opened by URI through pyarrow's file systems, in a folder that all executors share; an
archive is written under a name of its task attempt and the index names only the attempts that succeeded, so
a repeated task never mixes with a lost one.

Records with equal payloads of at least ``least_revisit`` bytes are stored once: the one with the largest page_id is
the response and the others are revisits that name it. A record's block is an HTTP header, whose
Content-Length is that of the full payload, and for a response the payload.

Defined cases: null html is an empty payload; a null url leaves out the target URI; line breaks in urls are
percent-encoded; a null page_id never stands for others and is never replaced; rows that repeat the largest
page_id are all responses; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_READ = 8 << 20
MOST_GAP = 64 << 10
TASK_BYTES = 16 << 20  # of archives that a task reads, about
SALTS = 8
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_ID = "urn:page:"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses.

    Payloads are grouped by length and SHA-1 with partial aggregation, and joined back under salts, as one payload may be that of
    a third of all pages; html itself moves once, by page_id.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marks = pages.select("page_id", F.sha1(html).alias("mark"), F.length(html).alias("n")).where(F.col("page_id").isNotNull() & (F.col("n") >= least_revisit))
    shared = marks.groupBy("mark", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    shared = shared.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = marks.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = salted.join(shared, ["mark", "n", "salt"]).where("page_id < refers_to").select("page_id", "mark", "n", "refers_to").distinct()
    wanted = pages.select("page_id", "url", "html").withColumns({"mark": F.sha1(html), "n": F.length(html)})
    return wanted.join(revisits, ["page_id", "mark", "n"], "left").select("page_id", "url", "html", "refers_to")


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int) -> tuple[bytes, str]:
    """A gzip member with one record, and its payload digest."""
    digest = base32_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", level, mtime=0), digest


def parse(data: bytes) -> tuple[int | None, str | None, str, int | None, int, str, bytes | None]:
    """page_id, url, type, refers_to, payload bytes, payload digest and payload of a gzip member.

    A response's payload is checked against its digest.
    """
    head, block = gzip.decompress(data).split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_digest(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = fields["WARC-Record-ID"].strip("<>").removeprefix(_ID)
    refers_to = fields.get("WARC-Refers-To")
    return (
        None if number == "null" else int(number),
        fields.get("WARC-Target-URI"),
        kind,
        int(refers_to.strip("<>").removeprefix(_ID)) if refers_to else None,
        size,
        digest,
        payload if kind == "response" else None,
    )


def write_archives(planned: DataFrame, folder: str, most_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Write the records below ``folder`` (a URI) and return the index rows, lazily: the caller stores them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, offset = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or offset >= most_bytes:
                    if out is not None:
                        out.close()
                    store.create_dir(root, recursive=True)
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data, digest = member(r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"], level)
                out.write(data)
                kind = "response" if r["refers_to"] is None else "revisit"
                rows.append({"page_id": r["page_id"], "file": name, "offset": offset, "length": len(data), "url": r["url"], "digest": digest, "record_type": kind, "refers_to": r["refers_to"]})
                offset += len(data)
            yield pa.RecordBatch.from_pylist(rows, _INDEX)
        if out is not None:
            out.close()

    return planned.mapInArrow(run, INDEX)


_INDEX = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def coalesce_ranges(rows: Iterator[tuple[str, int, int]], most: int = MOST_READ, gap: int = MOST_GAP) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, ranges) of joined reads over ranges sorted by file and offset."""
    file, start, end, ranges = "", 0, 0, []
    for name, offset, length in rows:
        if ranges and (name != file or offset > end + gap or offset + length - start > most):
            yield file, start, end, ranges
            ranges = []
        if not ranges:
            file, start, end = name, offset, offset
        ranges.append((offset, length))
        end = max(end, offset + length)
    if ranges:
        yield file, start, end, ranges


def read_records(index: DataFrame, folder: str, with_payload: bool = True, where: Column | None = None) -> DataFrame:
    """The records of the index rows (those that ``where`` holds for), as RECORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, handle = "", None
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
        for file, start, end, ranges in coalesce_ranges(rows):
            if file != name:
                if handle is not None:
                    handle.close()
                name, handle = file, store.open_input_file(f"{root}/{file}")
            handle.seek(start)
            data = handle.read(end - start)
            found = [parse(data[o - start : o - start + n]) for o, n in ranges]
            columns = list(zip(*found, strict=True))
            if not with_payload:
                columns[-1] = (None,) * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORDS, strict=True)], schema=_RECORDS)
        if handle is not None:
            handle.close()

    chosen = index if where is None else index.where(where)
    total = chosen.agg(F.sum("length")).first()[0] or 0
    parts = chosen.select("file", "offset", "length").withColumn("stripe", F.floor(F.col("offset") / MOST_READ))
    # Index rows are small and what they stand for is not, so the number of tasks follows from the bytes to be read.
    return parts.repartition(max(1, -(-total // TASK_BYTES)), "file", "stripe").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(run, RECORDS)
