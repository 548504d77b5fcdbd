"""WARC archives as a chunked record table.

A record is written as rows (archive, record, chunk, n_chunks, prefix_sha1, data): the data of an archive's rows in
the order of record and chunk is a valid WARC/1.1 file. Payloads beyond CHUNK_BYTES go out as several rows, cut from
the Arrow buffer without a copy of the whole record. Each row carries the SHA-1 of the payload up to its own end, so
that a reader checks a record chunk by chunk while it streams.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, small_batches

CHUNK_BYTES = 1 << 16
#: Payloads below this are never deduplicated.
MIN_REVISIT_BYTES = 1000
#: The table of repeated payloads (40-digit digest, length, id: about 100 bytes a row) is broadcast up to so many rows; beyond, the join shuffles.
BROADCAST_HOLDERS = 100_000
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

CHUNK_SCHEMA = "archive int, record long, chunk int, n_chunks int, prefix_sha1 string, data binary"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_CHUNK_ARROW = pa.schema([("archive", pa.int32()), ("record", pa.int64()), ("chunk", pa.int32()), ("n_chunks", pa.int32()), ("prefix_sha1", pa.string()), ("data", pa.binary())])
_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def plan_records(pages: DataFrame) -> DataFrame:
    """Digest, length, record type and reference of each row of pages(page_id, url, html).

    Among rows with equal payloads of MIN_REVISIT_BYTES or more, those with the largest page_id are responses and the
    others revisit it. A null html is an empty payload; payloads of any length are digested whole. A null page_id is never the one referred to, unless all ids of
    the payload are null: then all are responses. Repeated rows are records of their own.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    holders = (
        rows.filter(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("holder"), F.max_by("url", F.struct("page_id", "url")).alias("holder_url"), F.count("*").alias("n")).filter("n > 1 AND holder IS NOT NULL")
    )
    holders = materialize(holders.select(F.col("digest").alias("h_digest"), F.col("size").alias("h_size"), "holder", "holder_url"), "warc-holders")
    if holders.count() <= BROADCAST_HOLDERS:
        holders = F.broadcast(holders)
    rows = rows.join(holders, (F.col("digest") == F.col("h_digest")) & (F.col("size") == F.col("h_size")), "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return rows.select(
        "page_id", "url", "html", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("holder")).alias("refers_to"), F.when(revisit, F.col("holder_url")).alias("refers_url"),
    )


def _uri(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def _head(place: str, page_id: int | None, url: str | None, digest: str, size: int, kind: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """place: what tells the record from all others, also from those of a repeated row."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{place}:{page_id}:{digest}')}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{base32}"), ("X-Page-Id", "" if page_id is None else str(page_id))]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", str(refers_to))]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", _uri(refers_url)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + (size if kind == "response" else 0)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    archive, record, rows, held = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        small = {k: columns[k].to_pylist() for k in ("page_id", "url", "digest", "size", "record_type", "refers_to", "refers_url")}
        for i in range(batch.num_rows):
            page_id, url, digest, size, kind, refers_to, refers_url = (small[k][i] for k in small)
            payload = memoryview(columns["html"][i].as_buffer() or b"") if kind == "response" and size else memoryview(b"")
            n_chunks, sha = max(1, -(-len(payload) // CHUNK_BYTES)), hashlib.sha1()
            for chunk in range(n_chunks):
                part = payload[chunk * CHUNK_BYTES : (chunk + 1) * CHUNK_BYTES]
                sha.update(part)
                data = b"".join((_head(f"{archive}:{record}", page_id, url, digest, size, kind, refers_to, refers_url) if not chunk else b"", part, b"\r\n\r\n" if chunk == n_chunks - 1 else b""))
                rows.append((archive, record, chunk, n_chunks, sha.hexdigest(), data))
                held += len(data)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNK_ARROW.types, strict=True)], schema=_CHUNK_ARROW)
                    rows, held = [], 0
            record += 1
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNK_ARROW.types, strict=True)], schema=_CHUNK_ARROW)


def write_archives(pages: DataFrame) -> DataFrame:
    """Write a record per row of pages(page_id, url, html) to a chunk table in the shared folder; returns that table.

    One archive per task. Other columns are ignored. Defined cases: see plan_records.
    """
    small_batches(pages.sparkSession)
    return materialize(plan_records(pages).mapInArrow(_write, CHUNK_SCHEMA), "warc-chunks", "zstd")


def _fields(block: bytes) -> tuple[dict[str, str], int]:
    end = block.index(b"\r\n\r\n")
    lines = block[:end].decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, end + 4


class _Open:
    """A record while its chunks stream by; holds digests and counts, never the payload."""

    def __init__(self, key: tuple[int, int], data: bytes) -> None:
        if not data.startswith(b"WARC/1.1\r\n"):
            raise ValueError(f"record {key} does not begin with a WARC version")
        self.key, self.sha, self.seen = key, hashlib.sha1(), 0
        self.warc, at = _fields(data)
        self.http, body = _fields(data[at:])
        self.skip, self.left = at + body, int(self.warc["content-length"]) - body

    def add(self, data: bytes, prefix: str) -> None:
        part = memoryview(data)[self.skip :]
        part, self.skip = part[: min(len(part), self.left)], 0
        self.left -= len(part)
        self.seen += len(part)
        self.sha.update(part)
        if self.sha.hexdigest() != prefix:
            raise ValueError(f"record {self.key}: the payload differs from its running digest")

    def row(self) -> tuple:
        kind, digest = self.warc["warc-type"], base64.b32decode(self.warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        size = int(self.http["content-length"])
        if self.left or kind == "response" and (self.seen != size or self.sha.hexdigest() != digest):
            raise ValueError(f"record {self.key} is cut short or damaged")
        page, to = self.warc["x-page-id"], self.warc.get("x-refers-to-page")
        return int(page) if page else None, size, digest, kind, int(to) if to else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Open | None = None
    for batch in batches:
        rows = []
        for archive, record, chunk, n_chunks, prefix, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if chunk == 0:
                now = _Open((archive, record), data)
            if now is None or now.key != (archive, record):
                raise ValueError(f"record {(archive, record)}: chunk {chunk} comes without the first one")
            now.add(data, prefix)
            if chunk == n_chunks - 1:
                rows.append(now.row())
                now = None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD_ARROW.types, strict=True)], schema=_RECORD_ARROW)


def read_archives(chunks: DataFrame) -> DataFrame:
    """Read the records of a chunk table back, checking lengths and digests; raises on damage.

    Records of one chunk are read where they lie. Only the chunks of oversized ones are brought together, in order,
    and stream through without the record ever being held.
    """
    small_batches(chunks.sparkSession)
    whole = chunks.filter("n_chunks = 1").mapInArrow(_read, RECORD_SCHEMA)
    cut = chunks.filter("n_chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return whole.unionByName(cut.mapInArrow(_read, RECORD_SCHEMA))


def export_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write each archive to folder/archive-N.warc.gz, one gzip member per record; folder: a URI of a store that all nodes reach, or a path mounted on all.

    Returns archive, records.
    """
    target = folder if "://" in folder else f"file://{folder}"

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(target)
        name, out, member, count, done = None, None, None, 0, []
        for batch in batches:
            for archive, _, chunk, n_chunks, _, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if archive != name:
                    if out:
                        out.close()
                        done.append((name, count))
                    name, count, out = archive, 0, store.open_output_stream(f"{base}/archive-{archive:05d}.warc.gz", compression=None)
                if chunk == 0:
                    member = zlib.compressobj(wbits=31)
                out.write(member.compress(data))
                if chunk == n_chunks - 1:
                    out.write(member.flush())
                    count += 1
        if out:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_pydict({"archive": pa.array([x[0] for x in done], pa.int32()), "records": pa.array([x[1] for x in done], pa.int64())})

    ordered = chunks.repartition("archive").sortWithinPartitions("archive", "record", "chunk")
    return ordered.mapInArrow(files, "archive int, records long")


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of each record of an uncompressed WARC file."""
    while line := stream.readline():
        head = line
        while (line := stream.readline()) not in (b"\r\n", b""):
            head += line
        warc, _ = _fields(head + b"\r\n")
        block = stream.read(int(warc["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line breaks")
        http, at = _fields(block)
        yield warc, http, block[at:]


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p
), h AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS holder FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM h
"""
