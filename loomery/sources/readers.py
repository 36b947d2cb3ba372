"""Readers of message files into frames with explicit schemas."""

from __future__ import annotations

import contextlib
import email
import email.policy
import io
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MESSAGE = "path string, member string, label string, subject string, body string"


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, quotes doubled, fields over several lines; a byte order mark is dropped."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a bad line fails the read. Loose: bad lines stay in _corrupt_record. With file name."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("_input_file", F.col("_metadata.file_name"))
    loose = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(loose).option("mode", "PERMISSIVE").json(path).withColumn("_input_file", F.col("_metadata.file_name"))


def json_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.trim("value").substr(1, 1)).first()
    return spark.read.schema(schema).option("multiLine", bool(first) and first[0] == "[").json(path)


def split_document(spark: SparkSession, path: str, row: T.StructType) -> DataFrame:
    """{"splits": {"train": [...], "val": [...], "test": [...]}} as rows with a column split."""
    splits = T.StructType([T.StructField("splits", T.MapType(T.StringType(), T.ArrayType(row)))])
    doc = spark.read.schema(splits).option("multiLine", True).json(path)
    return doc.select(F.explode("splits").alias("split", "rows")).select("split", F.inline("rows"))


def labelled_lines(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Non-empty lines of text files, each file's rows with its label."""
    out = None
    for label, path in paths.items():
        rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("text"), F.lit(label).alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out


def message_text(raw: bytes) -> tuple[str, str]:
    """Subject, and the plain parts, or else the HTML parts; attachments are skipped."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    parts = [p for p in m.walk() if not p.is_multipart() and p.get_content_disposition() != "attachment"]
    found = {kind: [p for p in parts if p.get_content_type() == kind] for kind in ("text/plain", "text/html")}
    body = []
    for p in found["text/plain"] or found["text/html"]:
        data = p.get_payload(decode=True) or b""
        try:
            body.append(data.decode(p.get_content_charset() or "utf-8", "replace"))
        except LookupError:
            body.append(data.decode("utf-8", "replace"))
    return str(m.get("subject") or ""), "\n".join(body).strip()


def mime(df: DataFrame, raw: str) -> DataFrame:
    """df with subject and body of the messages in a binary column."""

    @F.pandas_udf("subject string, body string")
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([message_text(x or b"") for x in s], columns=["subject", "body"])

    return df.withColumn("_m", parse(raw)).select("*", "_m.subject", "_m.body").drop("_m")


MEMBER = "path string, member string, label string, raw binary"


def tar_members(spark: SparkSession, path: str, batch: int = 200) -> DataFrame:
    """Files in tar archives of any compression; the member's folder is the label.

    An archive is one value of at most 2 GB as it is stored, unpacked by one task as its stream goes, `batch` files at a time.
    """
    columns = ["path", "member", "label", "raw"]

    def members(batches):
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"]):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
                    for m in tar:
                        if not m.isfile():
                            continue
                        rows.append((where, m.name, m.name.split("/")[-2] if "/" in m.name else "", tar.extractfile(m).read()))
                        if len(rows) == batch:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, MEMBER)


def tar_mail(spark: SparkSession, path: str, batch: int = 200, tasks: int | None = None) -> DataFrame:
    """Messages in tar archives: one task unpacks an archive, and `tasks` (the shuffle's number) read its messages."""
    spread = tar_members(spark, path, batch).repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return mime(spread, "raw").select("path", "member", "label", "subject", "body")


def sheet_table(content: bytes, name: str | None = None, prefer: str = "emails") -> list[list[str]] | None:
    """Cells of a workbook's sheet: the named one (None if it isn't there), or the preferred one, else the first."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): target[s.get(f"{{{ns['r']}}}id")] for s in book.find("m:sheets", ns)}
        if name is not None and name not in sheets:
            return None
        part = sheets.get(name or prefer) or next(iter(sheets.values()))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = ET.fromstring(z.read("xl/" + part.removeprefix("/xl/")))
    table = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells: dict[int, str] = {}
        for c in row:
            letters = re.match("[A-Z]+", c.get("r") or "")
            at = 0
            for x in letters[0] if letters else "":
                at = at * 26 + ord(x) - 64
            at = at - 1 if letters else len(cells)
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
            else:
                v = c.find("m:v", ns)
                cells[at] = "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
        table.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return table


def sheet_rows(content: bytes, prefer: str = "emails") -> tuple[list[str], list[list[str]]]:
    """Header and rows of a workbook's preferred sheet, else its first; blank headers are col_<i>."""
    table = sheet_table(content, prefer=prefer)
    if not table:
        return [], []
    header = [h.strip() or f"col_{i}" for i, h in enumerate(table[0])]
    return header, [r + [""] * (len(header) - len(r)) for r in table[1:]]


def xlsx(spark: SparkSession, path: str, columns: list[str], prefer: str = "emails") -> DataFrame:
    """The named columns of workbooks as strings; one workbook is one task. Missing columns are null."""

    def rows(batches):
        for pdf in batches:
            for content in pdf["content"]:
                header, data = sheet_rows(content, prefer)
                at = [header.index(c) if c in header else None for c in columns]
                yield pd.DataFrame([[None if i is None else r[i] for i in at] for r in data], columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns))


def column_of(header: list[str], aliases: list[str]) -> str | None:
    """The first alias that the header has; decided when the plan is made."""
    have = {h.strip().lower(): h for h in header}
    return next((have[a.lower()] for a in aliases if a.lower() in have), None)


class Pages(DataSource):
    """Rows of a paged HTTP API: one partition for each page, read with retries. Options: url, pages, size."""

    @classmethod
    def name(cls) -> str:
        return "loomery_pages"

    def schema(self) -> str:
        return "page int, payload string"

    def reader(self, schema: T.StructType) -> "PageReader":
        return PageReader(dict(self.options))


def opened(url: str, tries: int = 5, opener=None, wait=None):
    """An open response; tried again after 429 and server errors, as long as Retry-After says or twice as long each time."""
    import time
    import urllib.error
    import urllib.request

    opener, wait = opener or (lambda u: urllib.request.urlopen(u, timeout=60)), wait or time.sleep
    for attempt in range(tries):
        try:
            return opener(url)
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or attempt + 1 == tries:
                raise
            after = (e.headers or {}).get("Retry-After") or ""
            wait(float(after) if after.strip().isdigit() else float(2**attempt))
        except (urllib.error.URLError, TimeoutError):
            if attempt + 1 == tries:
                raise
            wait(float(2**attempt))


def download(url: str, to: str, chunk: int = 2**20, **how) -> int:
    """Bytes of a url written to a file in chunks; the file appears only when it is whole."""
    import os

    size, part = 0, f"{to}.part"
    try:
        with opened(url, **how) as r, open(part, "wb") as f:
            while data := r.read(chunk):
                f.write(data)
                size += len(data)
        os.replace(part, to)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return size


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("pages", 1)))]

    def read(self, partition: InputPartition):
        size = int(self.options.get("size", 100))
        with opened(self.options["url"].format(offset=partition.value * size, length=size)) as r:
            yield partition.value, r.read().decode("utf-8")


def scan_ids(client, folder: str, limit: int, criteria: tuple[str, ...] = ("UNSEEN", "RECENT", "ALL")) -> list[bytes]:
    """The last `limit` message ids of the first search that finds any. client: logged in, as imaplib's."""
    client.select(folder)
    for c in criteria:
        status, found = client.search(None, c)
        if status == "OK" and found and found[0]:
            return found[0].split()[-limit:]
    return []


def fetched(client, ids: list[bytes]):
    """(id, subject, body) of messages, one at a time; those that can't be fetched are left out."""
    for i in ids:
        status, data = client.fetch(i, "(RFC822)")
        raw = next((d[1] for d in data or [] if isinstance(d, tuple)), None)
        if status == "OK" and raw is not None:
            yield (i.decode(), *message_text(raw))


@contextlib.contextmanager
def client_of(connect):
    """A client that is closed at the end, as far as it can be."""
    client = connect()
    try:
        yield client
    finally:
        for name in ("logout", "close", "shutdown"):
            if hasattr(client, name):
                getattr(client, name)()
                break


def mailbox_source(connect, folder: str = "INBOX", limit: int = 10, share: int = 50) -> type[DataSource]:
    """A data source over a mail server: the last messages of the first search that finds any, or as a stream those beyond
    the last id seen. connect() gives a logged-in client; register the class.

    The driver only asks for ids. Messages are fetched in shares of `share` ids, each by a task with a client of its own.
    """

    class Batch(DataSourceReader):
        def partitions(self):
            with client_of(connect) as client:
                ids = scan_ids(client, folder, limit)
            return [InputPartition(ids[i : i + share]) for i in range(0, len(ids), share)] or [InputPartition([])]

        def read(self, partition):
            with client_of(connect) as client:
                client.select(folder)
                yield from fetched(client, partition.value)

    class Poll(DataSourceStreamReader):
        def initialOffset(self):
            return {"id": 0}

        def latestOffset(self):
            with client_of(connect) as client:
                return {"id": max(map(int, scan_ids(client, folder, 10**9, ("ALL",))), default=0)}

        def partitions(self, start, end):
            low, high = start["id"], end["id"]
            return [InputPartition((i, min(i + share, high))) for i in range(low, high, share)]

        def read(self, partition):
            low, high = partition.value
            with client_of(connect) as client:
                ids = [i for i in scan_ids(client, folder, 10**9, ("ALL",)) if low < int(i) <= high]
                yield from fetched(client, ids)

        def commit(self, end):
            pass

    class Mailbox(DataSource):
        @classmethod
        def name(cls) -> str:
            return "loomery_mailbox"

        def schema(self) -> str:
            return "id string, subject string, body string"

        def reader(self, schema):
            return Batch()

        def streamReader(self, schema):
            return Poll()

    return Mailbox


def keyed_document(spark: SparkSession, path: str, row: T.StructType, key: str = "key") -> DataFrame:
    """{"a": [rows], "b": [rows]} as rows with their key; a missing file gives no rows."""
    doc = T.MapType(T.StringType(), T.ArrayType(row))
    text = spark.read.option("wholetext", True).option("ignoreMissingFiles", True).text(path)
    return text.select(F.explode(F.from_json("value", doc)).alias(key, "rows")).select(key, F.inline("rows"))


def cases(spark: SparkSession, path: str, required: list[str], languages: list[str]) -> tuple[DataFrame, DataFrame]:
    """Evaluation cases of JSON lines, and the lines refused with the first reason."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    reason = F.when(F.col("v").isNull(), "invalid JSON")
    for c in required:
        reason = reason.when(F.try_variant_get("v", f"$.{c}", "string").isNull(), f"missing {c}")
    reason = reason.when(~F.try_variant_get("v", "$.language", "string").isin(*languages), "unsupported language")
    lines = lines.withColumn("reason", reason)
    good = lines.where("reason is null").select(*(F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in required))
    return good, lines.where("reason is not null").select("value", "reason")


def file_quota(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Rows of a file-based frame up to balanced quotas per file, the remainder to the first files by name."""
    files = sorted(f.rsplit("/", 1)[1] for f in df.inputFiles())
    from ..operators.dedup import quota

    return quota(df.withColumn("_file", F.col("_metadata.file_name")), "_file", order, files, rows).drop("_file", "rank")
