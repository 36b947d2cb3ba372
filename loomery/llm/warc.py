"""WARC as a chunked record table.

An archive is a table of rows (archive, seq, record_id, chunk_no, data, sha1): the data of an archive's rows, joined in
the order of seq, are a valid WARC/1.1 file. Payloads are cut into chunks before they reach Python, each row carries the
SHA-1 of the record's payload so far, and the reader parses the rows as a stream: neither side holds a whole record.
One task writes archives of bounded size that no other task writes to, so a retried task replaces them as a whole.

Of records with equal payloads of at least REVISIT_BYTES the one with the largest page_id is a response (all rows of
it, if the id repeats) and the others are revisits without payload. Null html is an empty payload, a null url is
written as urn:unknown, control characters in urls are percent-encoded, and null ids stay null and never revisit.
Repeated rows are records of their own. Every record id is unique: that of a null or repeated page_id ends with its
place (archive and row), and a revisit of a repeated one names the page in a field of its own. An empty table gives no
records.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import drop, materialize, small_batches, tidy

CHUNK, REVISIT_BYTES = 64 * 1024, 1000
#: A task begins another archive after so many bytes, at a record's start; archive numbers are task * SEGMENTS + part.
ARCHIVE_BYTES, SEGMENTS = 8 * 2**20, 2**32
#: Revisits (some 60 bytes each) that may be broadcast to the payloads.
BROADCAST_REVISITS = 100_000
ARCHIVE = "archive long, seq long, record_id string, chunk_no int, data binary, sha1 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to (null for responses), again and refers_again: whether these ids repeat."""
    body = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).cast("binary").alias("payload"))
    body = body.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    narrow = materialize(body.select("page_id", "payload_digest", "payload_bytes").where(f"payload_bytes >= {REVISIT_BYTES} and page_id is not null"), "payloads")
    groups = narrow.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to")
    revisits = narrow.join(groups, ["payload_digest", "payload_bytes"]).where("page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    again = pages.select(F.col(id_col).cast("long").alias("page_id")).where("page_id is not null").groupBy("page_id").count().where("count > 1").select("page_id", F.lit(True).alias("again"))
    again = materialize(again, "repeated")
    revisits = materialize(revisits.join(again.withColumnsRenamed({"page_id": "refers_to", "again": "refers_again"}), "refers_to", "left"), "revisits")
    drop(narrow)
    repeated = again.count()
    if repeated:
        body = body.join(F.broadcast(again) if repeated <= BROADCAST_REVISITS else again, "page_id", "left")
    else:
        body = body.withColumn("again", F.lit(None).cast("boolean"))
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    return body.join(revisits, ["page_id", "payload_digest"], "left")


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """The archives of pages, as a written table."""
    small_batches(pages.sparkSession)
    rows = planned(pages, id_col, url_col, html_col).withColumn("chunk_no", F.explode(F.expr(f"sequence(0, if(refers_to is null, greatest(0, int((payload_bytes - 1) div {chunk})), 0))")))
    rows = rows.withColumn("data", F.expr(f"if(refers_to is null, substring(payload, chunk_no * {chunk} + 1, {chunk}), cast('' as binary))"))

    def head(name, url, size, digest, refers, refers_again) -> bytes:
        url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        fields = [
            "WARC/1.1",
            f"WARC-Type: {'response' if refers is None else 'revisit'}",
            f"WARC-Record-ID: {name}",
            "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {url}",
            f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Payload-Length: {size}",
            *([] if refers is None else [f"WARC-Refers-To-Page: {refers}" if refers_again else f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
            "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(http) + (size if refers is None else 0)}",
        ]
        return "\r\n".join(fields).encode() + b"\r\n\r\n" + http

    def put(batches):
        archive, seq, size_now, sha, name = TaskContext.get().partitionId() * SEGMENTS, 0, 0, hashlib.sha1(), ""
        for b in batches:
            out = []
            for page, url, size, digest, refers, again, refers_again, no, data in zip(*(c.to_pylist() for c in b.columns)):
                if no == 0:
                    sha = hashlib.sha1()
                    if size_now > ARCHIVE_BYTES:
                        archive, seq, size_now = archive + 1, 0, 0
                    name = f"<urn:page:{'null' if page is None else page}" + (f":{archive}-{seq}>" if again or page is None else ">")
                    out.append((archive, seq, name, -1, head(name, url, size, digest, refers, refers_again), None))
                    seq += 1
                sha.update(data)
                size_now += len(data)
                last = refers is not None or (no + 1) * chunk >= size
                out.append((archive, seq, name, no, data + b"\r\n\r\n" if last else data, sha.copy().hexdigest()))
                seq += 1
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names=["archive", "seq", "record_id", "chunk_no", "data", "sha1"])

    rows = rows.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "again", "refers_again", "chunk_no", "data")
    return materialize(rows.mapInArrow(tidy(put), ARCHIVE), "archives")


class Records:
    """Parses the bytes of one archive as they come; finished records are in done."""

    def __init__(self):
        self.done, self.buffer, self.left, self.state = [], b"", 0, "head"

    def feed(self, data: bytes) -> None:
        while data or self.state == "tail":
            if self.state in ("head", "http"):
                self.buffer += data
                at = self.buffer.find(b"\r\n\r\n")
                if at < 0:
                    return
                block, data, self.buffer = self.buffer[: at + 4], self.buffer[at + 4 :], b""
                if self.state == "head":
                    lines = block.decode().split("\r\n")
                    if lines[0] != "WARC/1.1":
                        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
                    self.field = dict(x.split(": ", 1) for x in lines[1:] if x)
                    self.left, self.sha, self.size, self.state = int(self.field["Content-Length"]), hashlib.sha1(), 0, "http"
                else:
                    self.left -= len(block)
                    self.state = "payload" if self.left else "tail"
            elif self.state == "payload":
                part, data = data[: self.left], data[self.left :]
                self.sha.update(part)
                self.size += len(part)
                self.left -= len(part)
                if not self.left:
                    self.state = "tail"
            else:
                self.buffer += data
                if len(self.buffer) < 4:
                    return
                if self.buffer[:4] != b"\r\n\r\n":
                    raise ValueError("a record doesn't end where its length says")
                data, self.buffer, self.state = self.buffer[4:], b"", "head"
                self.done.append(self.record())

    def record(self) -> tuple:
        f = self.field
        page = lambda x: None if x.startswith("<urn:page:null") else int(x[10:-1].partition(":")[0])
        digest, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"]
        if kind == "response" and (self.sha.hexdigest(), self.size) != (digest, int(f["WARC-Payload-Length"])):
            raise ValueError(f"the payload of {f['WARC-Record-ID']} doesn't have its digest")
        return page(f["WARC-Record-ID"]), f["WARC-Target-URI"], int(f["WARC-Payload-Length"]), digest, kind, None if kind != "revisit" else page(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else int(f["WARC-Refers-To-Page"])


def read(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record; payload digests are checked."""
    small_batches(archives.sparkSession)

    def parse(batches):
        at, records = None, Records()
        for b in batches:
            out = []
            for archive, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if archive != at:
                    at, records = archive, Records()
                records.feed(data)
                out += records.done
                records.done.clear()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names=[x.split()[0] for x in RECORD.split(", ")])

    rows = archives.select("archive", "seq", "data").repartition("archive").sortWithinPartitions("archive", "seq")
    return rows.select("archive", "data").mapInArrow(tidy(parse), RECORD)
