"""WARC archives: one gzip member for each record, read in sequence with bounded memory.

The reader decompresses a file in small steps, frames each record by its content length, and verifies its block and
payload digests while the bytes pass. It never holds more than a step and, if asked for, one payload.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_path, size_on_disk, written

STEP = 1 << 16
HEAD = 1 << 20
#: Digests of payloads that come more than once, as a written table up to this size, go to every task.
BROADCAST_BYTES = 16 << 20
ARCHIVE_BYTES = 256 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = re.compile(r"<urn:kinloom:page:(-?\d+)>")
DATE = "2000-01-01T00:00:00Z"  # archives of equal rows are equal, byte for byte


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def open_shared(uri: str, mode: str) -> BinaryIO:
    """A file in the shared folder: a mounted path, or a store that pyarrow knows by its URI."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        if "w" in mode:
            os.makedirs(os.path.dirname(parts.path), exist_ok=True)
        return open(parts.path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_stream(path)


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record as a gzip member: a response, or a revisit of the record of page `refers_to` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:kinloom:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:kinloom:page:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Members:
    """The bytes of a file of gzip members, one member after the other."""

    def __init__(self, file: BinaryIO):
        self.file, self.data, self.offset = file, b"", 0

    def _more(self) -> bool:
        if not self.data:
            self.data = self.file.read(STEP)
        return bool(self.data)

    def next(self) -> bool:
        """Goes to the next member; false at the end of the file."""
        if not self._more():
            return False
        self.unpacker, self.buffer, self.over = zlib.decompressobj(31), bytearray(), False
        return True

    def _fill(self) -> bool:
        """Some more bytes in `buffer`; false at the member's end."""
        while not self.over:
            if not self._more():
                raise EOFError("the file ends inside a record")
            before = len(self.data)
            got = self.unpacker.decompress(self.data, STEP)
            self.over = self.unpacker.eof
            self.data = self.unpacker.unused_data if self.over else self.unpacker.unconsumed_tail
            self.offset += before - len(self.data)
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        """The bytes before `mark`, which goes too."""
        while (at := self.buffer.find(mark)) < 0:
            if len(self.buffer) > most or not self._fill():
                raise ValueError("a record's header does not end")
        found = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return found

    def exactly(self, size: int) -> Iterator[bytes]:
        """The next `size` bytes in pieces."""
        while size:
            if not self.buffer and not self._fill():
                raise ValueError("a record is shorter than its content length")
            piece = bytes(self.buffer[:size])
            del self.buffer[: len(piece)]
            size -= len(piece)
            yield piece

    def drop(self) -> None:
        """The rest of the member, which goes."""
        self.buffer.clear()
        while self._fill():
            self.buffer.clear()

    def rest(self) -> bytes:
        while self._fill():
            if len(self.buffer) > STEP * 4:
                raise ValueError("a record is longer than its content length")
        return bytes(self.buffer)


def _headers(text: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = text.decode("utf-8", "replace").split("\r\n")
    found: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return first, found


def read_records(file: BinaryIO, with_payload: bool = False) -> Iterator[dict]:
    """The records of an open archive, in order.

    Each has type, record_id, refers_to, target_uri, content_type, offset, payload_bytes, payload_digest, digest_ok,
    payload and error. Size and digest of a revisit's payload are those its headers state, as the payload lies elsewhere. A
    damaged record has its error, and reading goes on with the next member; only where the compressed data themselves are damaged or cut
    it ends there, as nothing frames what follows. An HTTP block without a blank line in its first `HEAD` bytes is all payload.
    """
    members = Members(file)
    while members.next():
        row = dict.fromkeys(("type", "record_id", "refers_to", "target_uri", "content_type", "payload_bytes", "payload_digest", "digest_ok", "payload", "error"))
        row["offset"] = members.offset
        try:
            version, head = _headers(members.until(b"\r\n\r\n", 1 << 20))
            if not version.startswith("WARC/1."):
                raise ValueError(f"not a WARC record: {version[:40]}")
            row |= {"type": head["warc-type"], "record_id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "content_type": head.get("content-type")}
            block, payload, size, kept, http = hashlib.sha1(usedforsecurity=False), hashlib.sha1(usedforsecurity=False), 0, [], None
            start = bytearray() if (row["content_type"] or "").startswith("application/http") else None
            for piece in members.exactly(int(head["content-length"])):
                block.update(piece)
                if start is not None:
                    seen = max(0, len(start) - 3)
                    start += piece
                    if (at := start.find(b"\r\n\r\n", seen)) >= 0:
                        http, piece, start = _headers(bytes(start[:at]))[1], bytes(start[at + 4 :]), None
                    elif len(start) <= HEAD:
                        continue
                    else:
                        piece, start = bytes(start), None
                payload.update(piece)
                size += len(piece)
                if with_payload:
                    kept.append(piece)
            if start:
                payload.update(start)
                size += len(start)
                kept += [bytes(start)] if with_payload else []
            if members.rest() != b"\r\n\r\n":
                raise ValueError("a record is not framed by its content length")
            code = lambda digest: "sha1:" + base64.b32encode(digest.digest()).decode()
            row["digest_ok"] = head.get("warc-block-digest", code(block)) == code(block)
            if row["type"] == "revisit":
                size = int((http or {})["content-length"])
                digest = head["warc-payload-digest"]
            else:
                digest = code(payload)
                row["digest_ok"] &= head.get("warc-payload-digest", digest) == digest
                row["payload"] = b"".join(kept) if with_payload else None
            row |= {"payload_bytes": size, "payload_digest": digest.removeprefix("sha1:")}
        except (ValueError, KeyError) as error:
            row["error"] = f"{type(error).__name__}: {error}"
            try:
                members.drop()
            except (EOFError, zlib.error) as end:
                yield row
                yield dict.fromkeys(row) | {"offset": members.offset, "error": f"{type(end).__name__}: {end}"}
                return
        except (EOFError, zlib.error) as error:
            yield row | {"error": f"{type(error).__name__}: {error}"}
            return
        yield row


def write_archives(pages: DataFrame, directory: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, n_records, n_bytes) of the archives written for rows (page_id, url, payload binary, refers_to).

    A partition's records go to one archive after the other, each of about `archive_bytes`. File names hold the task's attempt and
    only those of the attempt that succeeded are returned, so a task can run again at any time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path, file, done = None, None, []
        try:
            for batch in batches:
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if file is None:
                        path = f"{directory}/{task.partitionId():06d}-{task.taskAttemptId():08d}-{len(done):04d}.warc.gz"
                        file, n, size = open_shared(path, "wb"), 0, 0
                    data = record(page_id, url, payload or b"", refers_to)
                    file.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= archive_bytes:
                        file.close()
                        done, file = [*done, (path, n, size)], None
        finally:
            if file is not None:
                file.close()
                done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "n_records", "n_bytes"])

    return written(arrow_map(pages.select("page_id", "url", "payload", "refers_to"), run, "path string, n_records long, n_bytes long"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives in column `path`: page_id long (null for other record ids), payload_bytes,
    payload_digest, record_type, refers_to long, digest_ok boolean, record_id, target_uri, content_type, path, offset, error,
    and payload binary if asked for."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", "record_id", "target_uri", "content_type", "path", "offset", "error"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, record_id string, target_uri string, content_type string, path string, offset long, error string"
    if with_payload:
        names, kinds, schema = [*names, "payload"], [*kinds, pa.binary()], schema + ", payload binary"

    def number(urn: str | None) -> int | None:
        return int(m[1]) if urn and (m := RECORD_ID.fullmatch(urn)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_shared(path, "rb") as file:
                    for r in read_records(file, with_payload):
                        row = (number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["type"], number(r["refers_to"]), r["digest_ok"], r["record_id"], r["target_uri"], r["content_type"], path, r["offset"], r["error"])
                        rows.append((*row, r["payload"]) if with_payload else row)
                        held += len(r["payload"] or b"")
                        if len(rows) >= 4096 or held > 1 << 24:
                            yield out()
                            rows, held = [], 0
        if rows:
            yield out()

    # the table of paths is small and would be read by one task; one archive for each task reads them side by side
    return arrow_map(archives.select("path").repartition(max(1, archives.count())), run, schema)


def with_revisits(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows for `write_archives`: of pages with equal payloads of at least `least_bytes` bytes that with the smallest id
    has no refers_to, the others that id."""
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # the aggregate combines copies before its shuffle, and only digests that come more than once take part in the join; payloads are shuffled
    # only where these are many, and then Spark splits a digest with very many pages
    copied = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copied = written(copied.select("sha", "least"), "copied")
    side = F.broadcast(copied) if size_on_disk(pages.sparkSession, copied) <= BROADCAST_BYTES else copied
    joined = rows.join(side, "sha", "left")
    refers_to = F.when(F.octet_length("payload") >= least_bytes, F.when(F.col("page_id").eqNullSafe(F.col("least")), None).otherwise(F.col("least")))
    return joined.select("page_id", "url", "payload", refers_to.alias("refers_to"))


def archive_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages as WARC archives in the shared folder and reads them back: one row for each row of `pages`.

    A null html is an empty payload, and empty payloads count as equal; rows that share the smallest id of equal payloads are
    all responses; a null id stays null and refers to nothing only if its group has no id at all; a null url has no target
    header; an empty table gives no rows; other columns are ignored.
    """
    directory = fresh_path(pages.sparkSession, "warc")
    archives = write_archives(with_revisits(pages, id_column, url_column, html_column, least_bytes), directory, archive_bytes)
    return read_archives(archives)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
d AS (SELECT page_id, CAST(strlen(b) AS BIGINT) AS payload_bytes, sha1(b) AS h FROM p),
g AS (SELECT h, min(page_id) AS least FROM d GROUP BY h)
SELECT d.page_id, d.payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(d.h, CAST(i // 4 AS INT) * 5 + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN d.page_id IS NOT DISTINCT FROM g.least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id IS DISTINCT FROM g.least THEN g.least END AS refers_to
FROM d JOIN g ON d.h = g.h
"""
