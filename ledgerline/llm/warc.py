"""WARC archives of pages: written with an index of records, read by byte ranges.

Each task writes its pages as records, one gzip member each, into archives of about
``ARCHIVE_BYTES`` in a shared folder, and returns an index row per record: archive,
offset, length, URL, payload digest. The index is a table that Spark commits, and archive
names are unique to a task attempt, so what a lost task wrote is never read.

Readers start from the index. The selected records are sorted by archive and offset, dealt to
as many tasks as their bytes ask for, and neighbours with a small gap become one read of at
most ``READ_BYTES`` (or one record).

Of the records with equal payloads, that with the largest page id is the ``response``,
the others are ``revisit`` records, which refer to it and hold the HTTP header only. Only
payloads that occur more than once are joined back to the pages; their table is written
first, so that Spark knows its size, broadcasts it if it is small, and otherwise splits
the skewed keys of a shuffled join.

Defined results: a NULL payload is empty; a NULL URL leaves out its header; a NULL page id
is less than any other; repeated rows with the largest id are all responses; an empty
table writes nothing; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.text import bound_batches
from ledgerline.sources.workspace import Workspace

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 8 << 20
# Bytes of records that one task reads back.
TASK_BYTES = 16 << 20
MOST_GAP = 64 << 10
LEAST_REVISIT_BYTES = 0
# Pages carry no time of their own.
NO_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = pa.schema(
    [("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    + [("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())]
)
INDEX_DDL = "page_id long, archive string, offset long, length long, url string, digest string, record_type string"
RECORDS = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)
RECORDS_DDL = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False
) -> tuple[bytes, str]:
    """(one record, payload digest)."""
    digest = base32_sha1(payload)
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {NO_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # A line break in a URL must not begin another header.
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {clean}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head = "\r\n".join(lines).encode("utf-8", "replace")
    return head + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(raw: bytes, verify: bool = True) -> dict:
    """Page id, payload size, digest, type and reference of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"no whole record: {fields.get('WARC-Record-ID')}")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if verify and not revisit and (len(payload) != stated or base32_sha1(payload) != digest):
        raise ValueError(f"payload and digest differ: {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "payload_bytes": stated,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": None if revisit else payload,
    }


class _Archives:
    """The archives that one task attempt writes, one after the other."""

    def __init__(self, folder: str, size: int):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.root, recursive=True)
        self.attempt, self.size, self.count, self.stream = uuid.uuid4().hex, size, 0, None

    def add(self, raw: bytes) -> tuple[str, int, int]:
        """(archive, offset, length) of a record that is written now."""
        if self.stream is None:
            self.name = f"{self.attempt}-{self.count:05d}.warc.gz"
            self.stream = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.count, self.offset = self.count + 1, 0
        packer = zlib.compressobj(wbits=31)
        member = packer.compress(raw) + packer.flush()
        self.stream.write(member)
        at = self.offset
        self.offset += len(member)
        place = self.name, at, len(member)
        if self.offset >= self.size:
            self.close()
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def _written(batches: Iterator[pa.RecordBatch], folder: str, size: int) -> Iterator[pa.RecordBatch]:
    archives = None
    for batch in batches:
        if archives is None:
            archives = _Archives(folder, size)
        found = []
        for row in batch.to_pylist():
            payload = (row["html"] or "").encode("utf-8", "replace")
            raw, digest = record(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"])
            kind = "revisit" if row["revisit"] else "response"
            found.append((row["page_id"], *archives.add(raw), row["url"], digest, kind))
        columns = zip(*found, strict=True) if found else [[] for _ in INDEX]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, INDEX, strict=True)], schema=INDEX
        )
    if archives is not None:
        archives.close()


def write_archives(
    pages: DataFrame,
    workspace: Workspace,
    least_revisit_bytes: int = LEAST_REVISIT_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """The index of the archives that are written for ``page_id``, ``url`` and ``html``."""
    bound_batches(pages.sparkSession)
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("key"))
    big = F.octet_length(F.coalesce("html", F.lit(""))) >= least_revisit_bytes
    copies = workspace.table(
        "repeated_payloads",
        lambda: keyed.where(big)
        .groupBy("key")
        .agg(F.count("*").alias("copies"), F.max("page_id").alias("response"))
        .where(F.col("copies") > 1)
        .select(F.col("key").alias("repeated"), "response"),
    )
    older = F.col("page_id").isNull() | (F.col("page_id") < F.col("response"))
    revisit = F.col("response").isNotNull() & older
    placed = keyed.join(copies, F.col("key") == F.col("repeated"), "left").select(
        "page_id",
        "url",
        # A revisit is written without its payload, but with its digest and length.
        "html",
        F.when(revisit, F.col("response")).alias("refers_to"),
        revisit.alias("revisit"),
    )
    run = partial(_written, folder=workspace.path("archives"), size=archive_bytes)
    return workspace.table("index", lambda: placed.mapInArrow(run, INDEX_DDL))


def reads(spans: list[tuple[int, int]], most_gap: int, most_bytes: int) -> list[tuple[int, int, list[int]]]:
    """(offset, length, numbers of the spans in it) of reads that cover sorted (offset, length) spans."""
    found: list[list] = []
    for number, (offset, length) in enumerate(spans):
        end = offset + length
        if found and offset <= found[-1][1] + most_gap and end - found[-1][0] <= most_bytes:
            found[-1][1] = max(found[-1][1], end)
            found[-1][2].append(number)
        else:
            found.append([offset, end, [number]])
    return [(a, b - a, numbers) for a, b, numbers in found]


def _read(
    batches: Iterator[pa.RecordBatch], folder: str, most_gap: int, most_bytes: int, with_payload: bool
) -> Iterator[pa.RecordBatch]:
    files = root = None
    for batch in batches:
        if files is None:
            files, root = fs.FileSystem.from_uri(folder)
        rows = batch.to_pydict()
        first = 0
        while first < batch.num_rows:
            name, last = rows["archive"][first], first
            while last < batch.num_rows and rows["archive"][last] == name:
                last += 1
            spans = list(zip(rows["offset"][first:last], rows["length"][first:last], strict=True))
            first = last
            with files.open_input_file(f"{root}/{name}") as archive:
                for offset, length, numbers in reads(spans, most_gap, most_bytes):
                    block = archive.read_at(length, offset)
                    found = []
                    for i in numbers:
                        at = spans[i][0] - offset
                        found.append(parse(zlib.decompress(block[at : at + spans[i][1]], wbits=31)))
                    if not with_payload:
                        for x in found:
                            x["payload"] = None
                    yield pa.RecordBatch.from_pylist(found, RECORDS)


def read_records(
    selected: DataFrame,
    workspace: Workspace,
    most_gap: int = MOST_GAP,
    most_bytes: int = READ_BYTES,
    with_payload: bool = True,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """The records of the index rows ``selected``, checked against their digests.

    Tasks follow the bytes to read, which the index knows; index rows are too small to tell.
    """
    places = selected.select("archive", "offset", "length")
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_bytes))
    dealt = places.repartitionByRange(tasks, "archive", "offset")
    sorted_places = dealt.sortWithinPartitions("archive", "offset")
    run = partial(
        _read, folder=workspace.path("archives"), most_gap=most_gap,
        most_bytes=most_bytes, with_payload=with_payload,
    )
    return sorted_places.mapInArrow(run, RECORDS_DDL)


def round_trip(pages: DataFrame, workspace: Workspace) -> DataFrame:
    """What the archives of all pages say of each page, read back record by record."""
    index = write_archives(pages, workspace)
    return read_records(index, workspace, with_payload=False).drop("payload")
