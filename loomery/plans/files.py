"""Tables written by the sinks and read again by the readers: what comes back is held against the table itself."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import validate as V
from ..operators.tables import shared_path
from ..sources import readers as R
from ..sources import sinks as W
from ..streaming import state as Z
from .registry import query
from .streams import events, finished

TEXTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


def place(t, name: str) -> str:
    return shared_path(t.spark, f"{name}-{uuid.uuid4().hex}")


def texts(t) -> DataFrame:
    return t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")


@query("select doc_id, md5(coalesce(text, '')) digest, source from documents")
def csv_round_trip(t):
    """Quotes, commas and line ends survive; CSV can't tell a null from an empty text, so both come back empty."""
    path = place(t, "csv")
    W.csv(texts(t).withColumn("text", F.replace("text", F.lit("\r"), F.lit("\\r"))), path)
    back = R.csv(t.spark, path, TEXTS).withColumn("text", F.replace(X.text("text"), F.lit("\\r"), F.lit("\r")))
    return back.select("doc_id", F.md5("text").alias("digest"), "source")


@query("select doc_id, md5(coalesce(text, '')) digest, source, (select count(*) from documents) written from documents")
def jsonl_round_trip(t):
    """Sorted keys, strict reading, and the writer's own count."""
    path = place(t, "jsonl")
    n = W.jsonl(texts(t), path, sort_keys=True)
    return R.jsonl(t.spark, path, TEXTS).select("doc_id", F.md5("text").alias("digest"), "source", F.lit(n).alias("written"))


@query("select doc_id, case when doc_id % 7 = 0 then null else md5(coalesce(text, '')) end digest, doc_id % 7 = 0 broken from documents")
def jsonl_loose(t):
    """Every seventh line is cut short: it stays, as text, in place of a row."""
    path = place(t, "loose")
    line = F.to_json(F.struct("doc_id", "text", "source"))
    cut = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "text'))
    texts(t).select(F.when(F.col("doc_id") % 7 == 0, cut).otherwise(line).alias("value")).write.text(path)
    rows = R.jsonl(t.spark, path, TEXTS, strict=False)
    bad = F.col("_corrupt_record").isNotNull()
    known = F.regexp_extract("_corrupt_record", r'"doc_id": (\d+)', 1).cast("long")
    return rows.select(F.when(bad, known).otherwise(F.col("doc_id")).alias("doc_id"), F.when(~bad, F.md5("text")).alias("digest"), bad.alias("broken"))


NATION = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType())])


@query("select 'region_' || n_regionkey region, cast(n_nationkey as bigint) n_nationkey, n_name from nation")
def keyed_document_rows(t):
    """One document of rows by key, as state files are."""
    per = t.nation.groupBy(F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("k")).agg(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")).alias("rows"))
    path = place(t, "keyed")
    per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "rows")))).alias("value")).coalesce(1).write.text(path)
    return R.keyed_document(t.spark, path, NATION, "region").select("region", "n_nationkey", "n_name")


@query("select case when n_regionkey < 2 then 'train' else 'test' end split, cast(n_nationkey as bigint) n_nationkey, n_name from nation")
def split_document_rows(t):
    split = F.when(F.col("n_regionkey") < 2, "train").otherwise("test")
    per = t.nation.groupBy(split.alias("k")).agg(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")).alias("rows"))
    path = place(t, "splits")
    per.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("k", "rows"))).alias("splits"))).alias("value")).coalesce(1).write.text(path)
    return R.split_document(t.spark, path, NATION)


@query("select cast(n_nationkey as bigint) n_nationkey, n_name, kind from nation, (values ('array'), ('lines')) v(kind)")
def json_by_first_character(t):
    """The same rows as a JSON array and as JSON lines."""
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    array, lines = place(t, "array"), place(t, "lines")
    rows.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).coalesce(1).write.text(array)
    W.jsonl(rows, lines)
    return R.json_any(t.spark, array, NATION).withColumn("kind", F.lit("array")).unionByName(R.json_any(t.spark, lines, NATION).withColumn("kind", F.lit("lines")))


@query("select split, doc_id from (select doc_id, case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'val' else 'test' end split from documents)")
def split_folders(t):
    path = place(t, "folders")
    d = F.col("doc_id") % 10
    W.splits(t.documents.select("doc_id", F.when(d < 7, "train").when(d < 9, "val").otherwise("test").alias("split")), path)
    return t.spark.read.parquet(path).select(F.col("split").cast("string").alias("split"), "doc_id")


@query("select role as label, count(*) n, count(distinct trim(x)) texts from (select role, regexp_replace(text, '[\\r\\n]+', ' ', 'g') x from conversations where role in ('user', 'assistant')) where trim(x) <> '' group by 1")
def labelled_line_counts(t):
    """Lines of a file for each label, empty ones left out."""
    paths = {}
    for role in ("user", "assistant"):
        paths[role] = place(t, role)
        t.conversations.where((F.col("role") == role) & F.col("text").isNotNull()).select(F.regexp_replace("text", "[\r\n]+", " ").alias("value")).write.text(paths[role])
    return R.labelled_lines(t.spark, paths).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


@query("select doc_id, lang from documents where lang in ('en', 'de') and doc_id % 5 <> 0 and text is not null and trim(text) <> ''")
def evaluation_cases(t):
    """Cases without a field, in another language or of broken JSON are refused."""
    path = place(t, "cases")
    made = t.documents.where("text is not null and trim(text) <> ''").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 5 != 0, F.md5("text")).alias("body"))
    made.select(F.to_json(F.struct("id", "language", "body")).alias("value")).write.text(path)
    good, _ = R.cases(t.spark, path, ["id", "language", "body"], ["en", "de"])
    return good.select(F.col("id").cast("long").alias("doc_id"), F.col("language").alias("lang"))


@query("select conv_id, turn, 'Turn ' || turn subject, md5(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) body from conversations")
def raw_messages(t):
    """Raw messages of every turn, parsed again."""
    head = F.concat(F.lit("Subject: Turn "), F.col("turn").cast("string"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"))
    raw = t.conversations.select("conv_id", "turn", F.concat(head, F.coalesce("text", F.lit(""))).cast("binary").alias("raw"))
    return R.mime(raw, "raw").select("conv_id", "turn", "subject", F.md5("body").alias("body"))


def sheet(pdfs):
    for pdf in pdfs:
        for content in pdf["content"]:
            header, rows = R.sheet_rows(content)
            yield pd.DataFrame(rows, columns=header, dtype=object)


@query("select cast(conv_id as varchar) conversation, cast(turn as varchar) step, coalesce(text, '') said from conversations")
def workbook_cells(t):
    """Workbooks of 500 turns at most each, read cell by cell."""
    rows = t.conversations.select((F.floor(F.col("conv_id") / 50)).alias("batch"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("conv_id").cast("string").alias("conversation"), F.col("turn").cast("string").alias("step"), F.coalesce("text", F.lit("")).alias("said"))
    return W.workbooks(rows, "batch", "ord").select("content").mapInPandas(sheet, "conversation string, step string, said string")


@query(f"""with s as (select cast(floor(conv_id / 50) as bigint) batch, coalesce(role, '') source, text from conversations)
select batch, true valid, count(*) row_count, array_to_string(list_sort(list(distinct source)), ',') sources, cast(count(*) filter (where length(text) > 1000) as bigint) truncated_cells from s group by 1""")
def workbook_checks(t):
    """Every workbook of 50 conversations passes all checks; cells of more than 1,000 characters were cut."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    rows = t.conversations.select(F.floor(F.col("conv_id") / 50).alias("batch"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("turn").cast("string").alias("step"), text.alias("said"), F.coalesce("role", F.lit("")).alias("source"))
    found = W.validated(W.workbooks(rows, "batch", "ord", limit=1000), ["step", "said", "source"])
    return found.select("batch", "valid", "row_count", F.array_join(F.array_sort(F.map_keys("source_counts")), ",").alias("sources"), "truncated_cells")


@query("select doc_id, cast(null as varchar) priority, lang from documents")
def missing_columns(t):
    """Columns that a source lacks come as nulls, found by their first alias otherwise."""
    rows = t.documents.select("doc_id", F.col("lang").alias("Language"))
    have = R.column_of(rows.columns, ["locale", "language"])
    return V.present(rows.withColumnRenamed(have, "lang"), {"priority": "string", "lang": "string"}).select("doc_id", "priority", "lang")


@query("select user_id, event_id, array_to_string(list_slice(l, greatest(1, len(l) - 2), len(l)), ',') context from (select user_id, event_id, coalesce(list(event_type) over (partition by user_id order by ts + to_microseconds(event_id) rows between unbounded preceding and 1 preceding), []) l from events)")
def stream_contexts(t):
    """Each event with the last three of its user, from keyed state."""
    rows = events(t).select(F.col("user_id").cast("string").alias("user"), (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("event_id").cast("decimal(18,6)") / 1_000_000)).alias("at"), F.concat_ws("#", "event_id", "event_type").alias("said"))
    out = finished(Z.contexts(rows, ["user"], "at", "said", n=3, days=3650), "append", ["user", "at", "said"])
    kinds = F.transform("context", lambda c: F.substring_index(c, "#", -1))
    return out.select(F.col("user").cast("long").alias("user_id"), F.substring_index("said", "#", 1).cast("long").alias("event_id"), F.array_join(kinds, ",").alias("context"))


@query("""with c as (select user_id, event_type, count(*) n from events group by 1, 2), p as (select user_id, arg_max(event_type, (ts, event_id)) preferred, count(*) corrections from events group by 1)
select user_id, preferred, corrections, count(*) tags, round(max(case when event_type = preferred then n end) / max(corrections), 9) confidence from p join c using (user_id) group by 1, 2, 3""")
def stream_last_tags(t):
    """The newest tag of each key, how many there were, and the share of corrections that agree with it, from typed state:
    the last write by event time wins, the later event on ties."""
    key = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    rows = events(t).select("user_id", "event_type", key.alias("at"))
    out = finished(Z.corrected_tags(rows, "user_id", "event_type", "at"), "update", ["user_id"])
    return out.select("user_id", "preferred", "corrections", "tags", F.round("confidence", 9).alias("confidence"))
