"""WARC archives of pages, written with revisit records and read as a table of payload chunks.

Reading streams each archive through a buffer of ``CHUNK`` bytes and yields rows (record, chunk number, chunk) with
the running length and SHA-1 of the payload so far; the last chunk of a record so carries those of the whole payload,
and no task ever holds a whole record. Archives are gzip members, one a record, as is usual for WARC."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import saved, shared_dir, spread_join

#: Bytes of a payload in one row, and about how many an archive holds before the next is begun.
CHUNK, ARCHIVE = 1 << 18, 1 << 26
#: Payloads shorter than this are always stored.
REVISIT_FROM = 1000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(value: str) -> str:
    """A header value without line ends and other control characters, which are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def with_record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, digest, refers_to): which records are stored and which revisit another.

    Of records with equal payloads of REVISIT_FROM bytes or more, the one with the largest id is stored. Which those are
    follows from ids, digests and sizes alone; payloads are shuffled once, copies of one payload in shares by id."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    about = saved(rows.select("id", "url", "digest", F.octet_length("payload").alias("size")))
    kept = about.where(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "kept")
    rows = spread_join(rows, kept, "digest", ["id", "url"], "left", keys=about)
    refers = F.when(~F.col("id").eqNullSafe(F.col("kept")), F.col("kept"))
    return rows.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def _record(id_: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> tuple[bytes, bytes]:
    """(WARC header, HTTP header) of a record whose payload follows unless it is a revisit."""
    http = _HTTP % size
    name = "-" if id_ is None else str(id_)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {digest} {url}')}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-ID: {name}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n", http


def _archived(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    out, name, held, records, k = None, "", 0, 0, 0
    done: list[tuple[str, int]] = []

    def close() -> None:
        nonlocal out, held, records, k
        out.close()
        system.move(f"{path}/{name}", f"{path}/{(final := f'{task:06d}-{k:05d}.warc.gz')}")
        done.append((final, records))
        out, held, records, k = None, 0, 0, k + 1

    for b in batches:
        ids, urls, digests, refers = (b.column(c).to_pylist() for c in ("id", "url", "digest", "refers_to"))
        payloads = b.column("payload")
        for row in range(b.num_rows):
            if out is None:
                name = f"_{uuid.uuid4().hex}.tmp"
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            payload = memoryview(payloads[row].as_buffer())
            packer = zlib.compressobj(1, zlib.DEFLATED, 31)
            header, http = _record(ids[row], urls[row], len(payload), digests[row], refers[row])
            out.write(packer.compress(header + http))
            if refers[row] is None:
                for at in range(0, len(payload), CHUNK):
                    out.write(packer.compress(payload[at : at + CHUNK]))
                held += len(payload)
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            held, records = held + len(header), records + 1
            if held >= most:
                close()
    if out is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "records"])


def write_warc(pages: DataFrame, folder: str, most: int = ARCHIVE, **columns: str) -> DataFrame:
    """Writes a record for each row of ``pages`` to archives in ``folder``; returns (file, records) of each archive.

    Archives are written under another name and renamed, so a task that runs twice leaves one whole archive. A null
    html is an empty payload; a null url is left out of its record; a null id is written as "-" and never kept for
    others. Rows that repeat the kept id and its payload are all stored. An empty table writes no archive."""
    rows = with_record_types(pages, **columns)
    found = rows.mapInArrow(lambda batches: _archived(batches, folder, most), "file string, records long")
    return saved(found)


class _Gunzip:
    """The bytes of concatenated gzip members, read in small pieces."""

    def __init__(self, stream) -> None:
        self.stream, self.unpacker, self.rest = stream, None, b""
        self.buffer = b""

    def _more(self, most: int) -> bytes:
        while True:
            if not self.rest:
                self.rest = self.stream.read(CHUNK)
                if not self.rest:
                    return b""
            if self.unpacker is None:
                self.unpacker = zlib.decompressobj(31)
            out = self.unpacker.decompress(self.rest, most)
            self.rest = self.unpacker.unconsumed_tail or self.unpacker.unused_data
            if self.unpacker.eof:
                self.unpacker = None
            if out:
                return out

    def until(self, mark: bytes) -> bytes:
        """Up to and with the next mark; less if the stream ends."""
        while (at := self.buffer.find(mark)) < 0:
            got = self._more(CHUNK)
            if not got:
                out, self.buffer = self.buffer, b""
                return out
            self.buffer += got
        out, self.buffer = self.buffer[: at + len(mark)], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes in pieces of at most CHUNK."""
        while n:
            if not self.buffer:
                self.buffer = self._more(CHUNK)
                if not self.buffer:
                    raise EOFError("archive ends inside a record")
            size = min(n, CHUNK, len(self.buffer))
            out, self.buffer = self.buffer[:size], self.buffer[size:]
            n -= size
            yield out


def _pieces(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes in pieces of CHUNK, but for the last."""
    held = bytearray()
    for p in pieces:
        held += p
        while len(held) >= CHUNK:
            yield bytes(held[:CHUNK])
            del held[:CHUNK]
    yield bytes(held)


_CHUNKS = "file string, record long, chunk int, last boolean, id long, url string, record_type string, refers_to long, bytes long, sha1 string, payload_bytes long, payload_digest string, data binary"


def _chunks(batches: Iterator[pa.RecordBatch], folder: str, data: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("record", pa.int64()), ("chunk", pa.int32()), ("last", pa.bool_()), ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary())])
    system, path = fs.FileSystem.from_uri(folder)
    rows: list[tuple] = []
    held = 0

    def flushed() -> pa.RecordBatch:
        nonlocal rows, held
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        rows, held = [], 0
        return out

    for b in batches:
        for file in b.column("file").to_pylist():
            with system.open_input_stream(f"{path}/{file}", compression=None, buffer_size=CHUNK) as stream:
                source, number = _Gunzip(stream), 0
                while header := source.until(b"\r\n\r\n"):
                    lines = header.decode("utf-8", "replace").strip().split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise ValueError(f"{file}: record {number} has no WARC header")
                    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
                    http = source.until(b"\r\n\r\n")
                    body = int(head["content-length"]) - len(http)
                    page, refers = head["x-page-id"], head.get("x-refers-to-page-id")
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    about = (None if page == "-" else int(page), head.get("warc-target-uri"), head["warc-type"], None if refers is None else int(refers))
                    size = int(head["x-payload-length"])
                    sha, so_far, k = hashlib.sha1(), 0, 0
                    for piece in _pieces(source.take(body)):
                        sha.update(piece)
                        so_far += len(piece)
                        last = so_far == body
                        rows.append((file, number, k, last, *about, so_far, sha.copy().hexdigest(), size, digest, piece if data else None))
                        held, k = held + len(piece) * data + 200, k + 1
                        if held >= 16 * CHUNK:
                            yield flushed()
                        if last:
                            break
                    source.until(b"\r\n\r\n")
                    number += 1
    if rows:
        yield flushed()


def read_warc_chunks(spark: SparkSession, folder: str, files: DataFrame, data: bool = True) -> DataFrame:
    """The chunk table of archives: a row for each record and chunk number, with the payload's running length (bytes)
    and SHA-1 (sha1), what its header says of the whole payload, and the chunk itself unless ``data`` is false."""
    names = files.select("file").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return names.mapInArrow(lambda batches: _chunks(batches, folder, data), _CHUNKS)


def records(chunks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to) of each record, from its last chunk.

    For a stored payload both figures come from its bytes; a revisit has none and states those of its header."""
    stored = F.col("record_type") == "response"
    pick = lambda a, b: F.when(stored, F.col(a)).otherwise(F.col(b))
    return chunks.where("last").select(F.col("id").alias(id_col), pick("bytes", "payload_bytes").alias("payload_bytes"), pick("sha1", "payload_digest").alias("payload_digest"), "record_type", "refers_to")


def warc_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", **columns: str) -> DataFrame:
    """records() of archives written from ``pages`` to ``folder``."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    files = write_warc(pages, folder, id_col=id_col, **columns)
    return records(read_warc_chunks(spark, folder, files, data=False), id_col)


#: The same for DuckDB.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS kept FROM d WHERE n >= 1000 GROUP BY digest),
r AS (SELECT d.page_id, n, d.digest, CASE WHEN n >= 1000 AND kept IS DISTINCT FROM page_id THEN kept END AS refers_to FROM d LEFT JOIN k ON d.digest = k.digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CAST(refers_to AS BIGINT) AS refers_to FROM r
"""
