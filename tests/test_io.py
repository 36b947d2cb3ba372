"""File readers and writers on small files."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.sources import readers as R
from loomery.sources import sinks as W

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("body", T.StringType())])


def test_jsonl_strict_and_loose(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": 1, "body": "a"}\n{"id": 2, "body": "b"}\n')
    assert R.jsonl(spark, str(p), ROW).count() == 2
    p2 = tmp_path / "y.jsonl"
    p2.write_text('{"id": 1, "body": "a"}\nnot json\n')
    with pytest.raises(Exception):
        R.jsonl(spark, str(p2), ROW).collect()
    rows = R.jsonl(spark, str(p2), ROW, strict=False).collect()
    assert [r["_corrupt_record"] for r in rows] == [None, "not json"] and rows[0]["_input_file"] == "y.jsonl"


def test_json_array_or_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "body": "x"}, {"id": 2, "body": "y"}]')
    (tmp_path / "b.json").write_text('{"id": 3, "body": "z"}\n')
    assert R.json_any(spark, str(tmp_path / "a.json"), ROW).count() == 2
    assert R.json_any(spark, str(tmp_path / "b.json"), ROW).first()["id"] == 3


def test_split_document_and_lines(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"splits": {"train": [{"id": 1, "body": "x"}], "test": []}}')
    assert [tuple(r) for r in R.split_document(spark, str(tmp_path / "s.json"), ROW).collect()] == [("train", 1, "x")]
    (tmp_path / "p.txt").write_text("one\n\ntwo\n")
    assert R.labelled_lines(spark, {"yes": str(tmp_path / "p.txt")}).count() == 2


def test_csv_with_quotes_and_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿id,body\n1,"a ""b""\nc"\n', encoding="utf-8")
    assert tuple(R.csv(spark, str(tmp_path / "c.csv"), ROW).first()) == (1, 'a "b"\nc')


def test_tar_of_messages(spark, tmp_path):
    raw = b"Subject: =?utf-8?q?H=C3=A9?=\nContent-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nhello\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename=x\n\nno\n--b--\n"
    with tarfile.open(tmp_path / "m.tar.bz2", "w:bz2") as tar:
        info = tarfile.TarInfo("mail/spam/0001")
        info.size = len(raw)
        tar.addfile(info, io.BytesIO(raw))
    r = R.tar_mail(spark, str(tmp_path / "m.tar.bz2")).first()
    assert (r["label"], r["subject"], r["body"]) == ("spam", "Hé", "hello")


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a<b>", "x" * 50), (1, 1, "c\x00d", None), (2, 2, "e", "f")], "batch long, ord long, body string, note string")
    for r in W.workbooks(df, "batch", "ord", limit=30).collect():
        (tmp_path / f"b{r['batch']}.xlsx").write_bytes(bytes(r["content"]))
    got = R.xlsx(spark, str(tmp_path / "b1.xlsx"), ["body", "note", "absent"]).collect()
    assert [tuple(r) for r in got] == [("a<b>", "x" * 18 + " [TRUNCATED]", None), ("cd", "", None)]
    assert tuple(W.invalid_cells(df.select("body", "note"), 30).first()) == (3, 1, 1)


def test_json_writer_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (2, "a")], "z long, a string")
    assert W.jsonl(df, str(tmp_path / "o"), sort_keys=True) == 2
    assert W.manifest(df, "a") == {"a": 1, "b": 1}
    text = "".join(p.read_text() for p in (tmp_path / "o").glob("*.json"))
    assert '{"a":"b","z":1}' in text


def test_alias_choice():
    assert R.column_of(["Subject ", "Body"], ["text", "body"]) == "Body"
    assert R.column_of([], ["x"]) is None


def test_message_text_of_garbage():
    assert R.message_text(b"") == ("", "")
    assert R.message_text(b"Content-Type: text/plain; charset=nope\n\nx")[1] == "x"


def test_keyed_document_and_cases(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"u_a": [{"id": 1, "body": "x"}, {"id": 2, "body": "y"}], "u_b": []}')
    assert [tuple(r) for r in R.keyed_document(spark, str(tmp_path / "k.json"), ROW).orderBy("id").collect()] == [("u_a", 1, "x"), ("u_a", 2, "y")]
    (tmp_path / "c.jsonl").write_text('{"id": "1", "language": "en", "body": "b"}\n{"id": "2", "language": "xx", "body": "b"}\nbad\n\n{"id": "3", "language": "en"}\n')
    good, bad = R.cases(spark, str(tmp_path / "c.jsonl"), ["id", "language", "body"], ["en"])
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["invalid JSON", "missing body", "unsupported language"]


def test_file_quota(spark, tmp_path):
    for name in "ab":
        spark.range(10).coalesce(1).write.json(str(tmp_path / name))
    import shutil

    (tmp_path / "in").mkdir()
    for name in "ab":
        shutil.copy(next((tmp_path / name).glob("part-*.json")), tmp_path / "in" / f"{name}.json")
    got = R.file_quota(spark.read.schema("id long").json(str(tmp_path / "in")), "id", 5)
    assert sorted(r["id"] for r in got.collect()) == [0, 0, 1, 1, 2]


def test_head_saves_and_loads(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    from loomery.operators.learn import Head

    rows = spark.createDataFrame([(i, Vectors.dense([float(i % 2), 1.0]), "odd" if i % 2 else "even") for i in range(20)], ["id", "features", "y"])
    head = Head(iterations=5).fit(rows, "y")
    head.save(str(tmp_path / "h"))
    pick = lambda h: [tuple(r) for r in h.predict(rows, "p").select("id", "p", "p_confidence").orderBy("id").collect()]
    assert pick(Head.load(str(tmp_path / "h"))) == pick(head)


class Answers:
    """Opens urls from a list of prepared answers."""

    def __init__(self, *answers):
        self.answers = list(answers)

    def __call__(self, url):
        import urllib.error
        from email.message import Message

        a = self.answers.pop(0)
        if isinstance(a, bytes):
            return io.BytesIO(a)
        head = Message()
        if a[1]:
            head["Retry-After"] = a[1]
        raise urllib.error.HTTPError(url, a[0], "no", head, None)


def test_download_waits_and_tries_again(tmp_path):
    waits = []
    to = tmp_path / "f"
    assert R.download("http://x", str(to), chunk=3, opener=Answers((429, "7"), (503, ""), b"0123456789"), wait=waits.append) == 10
    assert waits == [7.0, 2.0] and to.read_bytes() == b"0123456789"
    with pytest.raises(Exception):
        R.download("http://x", str(tmp_path / "g"), opener=Answers((404, "")), wait=waits.append)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f"]


def test_paged_reader(monkeypatch):
    import urllib.request

    asked = []
    monkeypatch.setattr(urllib.request, "urlopen", lambda u, timeout: asked.append(u) or io.BytesIO(b'{"rows": []}'))
    reader = R.Pages({"url": "http://x?o={offset}&n={length}", "pages": "2", "size": "50"}).reader(None)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert asked == ["http://x?o=0&n=50", "http://x?o=50&n=50"] and [r[0] for r in rows] == [0, 1]


class Server:
    """A mail client over prepared messages."""

    def __init__(self, found, mail):
        self.found, self.mail = found, mail

    def select(self, folder):
        return "OK", [b""]

    def search(self, charset, criteria):
        return "OK", [self.found.get(criteria, b"")]

    def fetch(self, i, what):
        return ("OK", [(b"", self.mail[i])]) if i in self.mail else ("NO", [None])


MAIL = {str(i).encode(): f"Subject: s{i}\nContent-Type: text/plain\n\nb{i}".encode() for i in range(1, 5)}


def test_mailbox_scan_and_poll():
    server = Server({"RECENT": b"1 2 3 9", "ALL": b"1 2 3 4"}, MAIL)
    assert R.scan_ids(server, "INBOX", 2) == [b"3", b"9"] and R.scan_ids(Server({}, {}), "INBOX", 2) == []
    read = lambda reader, parts: [list(reader.read(p)) for p in parts]
    source = R.mailbox_source(lambda: server, limit=3, share=2)({})
    batch = source.reader(None)
    assert read(batch, batch.partitions()) == [[("2", "s2", "b2"), ("3", "s3", "b3")], []]  # two tasks; 9 can't be fetched
    poll = source.streamReader(None)
    end = poll.latestOffset()
    assert end == {"id": 4} and poll.partitions(end, end) == []
    got = read(poll, poll.partitions(poll.initialOffset(), end))
    assert [[r[0] for r in rows] for rows in got] == [["1", "2"], ["3", "4"]]
    assert [[r[0] for r in rows] for rows in read(poll, poll.partitions({"id": 1}, {"id": 3}))] == [["2", "3"]]
    nothing = R.mailbox_source(lambda: Server({}, {}))({}).reader(None)
    assert read(nothing, nothing.partitions()) == [[]]


def test_messages_of_one_archive_are_read_by_several_tasks(spark, tmp_path):
    with tarfile.open(tmp_path / "m.tar.bz2", "w:bz2") as tar:
        for i in range(40):
            raw = f"Subject: s{i}\nContent-Type: text/plain\n\nbody {i}\n".encode()
            info = tarfile.TarInfo(f"mail/{'spam' if i % 2 else 'ham'}/{i:04}")
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    got = R.tar_mail(spark, str(tmp_path / "m.tar.bz2"), tasks=4).select("label", "subject", "body", F.spark_partition_id().alias("task")).collect()
    assert {(r["subject"], r["label"], r["body"].strip()) for r in got} == {(f"s{i}", "spam" if i % 2 else "ham", f"body {i}") for i in range(40)}
    assert len({r["task"] for r in got}) == 4


def test_workbook_checks_find_what_is_wrong(spark):
    import io
    import zipfile

    from loomery.sources import sinks as W

    head = ["subject", "body", "source"]
    good = W.workbook(head, [["a", "b", "x"], ["c", "d", "y"]])

    def edited(name, change):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(good)) as z, zipfile.ZipFile(out, "w") as w:
            for n in z.namelist():
                data = z.read(n)
                data = change(data) if n == name else data
                if data is not None:
                    w.writestr(n, data)
        return out.getvalue()

    sheet = "xl/worksheets/sheet1.xml"
    cases = [
        (good, []), (None, ["no content"]), (b"zip", ["no zip archive"]), (W.workbook(head, []), ["no rows"]), (W.workbook(["x"], [["1"]]), ["other header", "row 2: 1 cells"]), (W.workbook(head, [["a", "b", "z"]]), ["row 2: unknown source"]),
        (W.workbook(head, [["a", "b", "x"]], "other"), ["no sheet emails"]), (edited(sheet, lambda x: x.replace(b"<c ", b"<c><f>1</f></c><c ", 1)), ["formulas", "other header", "row 2: 3 cells"]),
        (edited(sheet, lambda x: x[:-5]), [f"{sheet} is no XML", "can't be read"]), (edited(sheet, lambda x: None), ["no first sheet", "can't be read"]),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "batch long, content binary")
    got = {r["batch"]: r for r in W.validated(df, head, sources=["x", "y"]).collect()}
    for i, (_, want) in enumerate(cases):
        errors = list(got[i]["errors"])
        assert (errors[:2] == want[:2] if i == 7 else errors == want) and got[i]["valid"] == (not want), (i, errors)
    assert (got[0]["row_count"], got[0]["source_counts"]) == (2, {"x": 1, "y": 1})
