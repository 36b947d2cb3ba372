"""Audit documents, leakage between splits, two-label integrity, class names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import dedup as D
from ..operators import quality as Q
from ..operators import validate as V
from ..operators.tables import keep_table
from .corpus import N1, near, near_sql
from . import mailbox as Mb
from .registry import query
from .rules import TAGGED


@query(f"""with {near_sql(20, 0.6)}, l as (select *, md5({N1.format('text')}) h, case when coalesce(text, '') = '' then 'empty text' when quality is null then 'no label' end reason, least(length(text) / 1000.0, 1.0) confidence from documents left join labels using (doc_id)),
ok as (select *, row_number() over (partition by h order by doc_id) r from l where reason is null), d as (select * from ok where r = 1), q as (select quality, count(*) n from d group by 1), c as (select distinct quality from d), o as (select distinct toxic from d)
select 'rows' metric, '' item, count(*) n from l union all select 'valid_rows', '', count(*) from d union all select 'rejected_rows', '', count(*) from l where reason is not null union all select 'rejections', reason, count(*) from l where reason is not null group by 2
union all select 'exact_duplicate_texts', '', count(*) from ok where r > 1 union all select 'duplicate_ids', '', count(*) from (select doc_id from ok group by 1 having count(*) > 1)
union all select 'near_duplicate_pairs', '', count(*) from alike where ws >= 0.35 and cs >= 0.85
union all select 'quality', cast(quality as varchar), n from q union all select 'toxic', cast(toxic as varchar), count(*) from d where toxic is not null group by 2 union all select 'quality_x_toxic', c.quality || '|' || o.toxic, count(d.doc_id) from c cross join o left join d on d.quality = c.quality and d.toxic = o.toxic where o.toxic is not null group by 2
union all select 'source', source, count(*) from d where source is not null group by 2 union all select 'language', lang, count(*) from d where lang is not null group by 2 union all select 'synthetic', case when source = 'src0' then 'yes' else 'no' end, count(*) from d where source is not null group by 2
union all select 'low_confidence', '', count(*) from d where confidence < 0.7 union all select 'warnings', quality || ': ' || case when n < 10 then 'rare' else 'imbalanced' end, n from q where n < 10 or (select max(n) from q) / n > 10
union all select 'columns', unnest(['doc_id', 'lang', 'n_chars', 'source', 'text']), 1 union all select 'characters', '', sum(length(text)) from l""")
def audit_report(t):
    """A whole audit as rows (metric, item, n): what is valid, rejected and why, duplicates by id, text and likeness,
    distributions and cross-tab of the labels with zeros, sources, languages, low confidence, warnings, columns, size."""
    x = t.documents.join(t.labels, "doc_id", "left").withColumn("h", F.md5(X.norm_basic("text")))
    reason = F.when(F.coalesce("text", F.lit("")) == "", "empty text").when(F.col("quality").isNull(), "no label")
    x = keep_table(x.select("doc_id", "lang", "source", "quality", "toxic", "h", reason.alias("reason"), F.length("text").alias("chars")))
    valid = x.where("reason is null")
    first = valid.groupBy("h").agg(F.min_by(F.struct("doc_id", "lang", "source", "quality", "toxic", "chars"), "doc_id").alias("r")).select("r.*")
    d = keep_table(first)
    one = lambda metric, df: df.agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("item"), "n")
    by = lambda metric, df, c: Q.distribution(df.where(c.isNotNull()).withColumn("item", c.cast("string")), "item").select(F.lit(metric).alias("metric"), "item", "n")
    tab = Q.cross_tab(d.where("toxic is not null"), "quality", "toxic").select(F.lit("quality_x_toxic").alias("metric"), F.concat_ws("|", "quality", "toxic").alias("item"), "n")
    warned = Q.imbalance(Q.distribution(d, "quality")).where("warning <> ''").select(F.lit("warnings").alias("metric"), F.concat(F.col("quality").cast("string"), F.lit(": "), F.col("warning")).alias("item"), "n")
    columns = t.spark.createDataFrame([("columns", c, 1) for c in t.documents.columns], "metric string, item string, n long")
    again = valid.join(d.select("doc_id"), "doc_id", "left_anti")
    _, pairs = near(t, words=1.0, ratio=0.6, least=20)
    parts = [
        one("rows", x), one("valid_rows", d), one("rejected_rows", x.where("reason is not null")), by("rejections", x, F.col("reason")), one("exact_duplicate_texts", again), one("duplicate_ids", valid.groupBy("doc_id").count().where("count > 1")),
        one("near_duplicate_pairs", pairs.where("word_sim >= 0.35 and char_sim >= 0.85")), by("quality", d, F.col("quality")), by("toxic", d, F.col("toxic")), tab, by("source", d, F.col("source")), by("language", d, F.col("lang")),
        by("synthetic", d, F.when(F.col("source").isNotNull(), F.when(F.col("source") == "src0", "yes").otherwise("no"))), one("low_confidence", d.where("chars < 700")), warned, columns,
        x.agg(F.sum("chars").alias("n")).select(F.lit("characters").alias("metric"), F.lit("").alias("item"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(f"select md5({N1.format('text')}) key, count(*) n, count(distinct quality) qualities, count(distinct toxic) toxics from documents join labels using (doc_id) group by 1 having count(distinct quality) > 1 or count(distinct toxic) > 1")
def two_label_conflicts(t):
    x = t.documents.join(t.labels, "doc_id").groupBy(F.md5(X.norm_basic("text")).alias("key"))
    return x.agg(F.count("*").alias("n"), F.countDistinct("quality").alias("qualities"), F.countDistinct("toxic").alias("toxics")).where("qualities > 1 or toxics > 1")


@query(f"with {near_sql(15, 0.7)}, d as (select *, case when substr(md5('42:' || a), 1, 1) < 'c' then 'train' else 'test' end split_a, case when substr(md5('42:' || b), 1, 1) < 'c' then 'train' else 'test' end split_b from alike where ws >= 0.35 and cs >= 0.85) select a, b, round(cs, 9) char_sim, split_a, split_b from d where split_a <> split_b")
def near_split_leakage(t):
    """Pairs of texts alike by characters (0.85, and 0.35 by words) that fell into different splits."""
    _, pairs = near(t)
    split = lambda c: F.when(F.substring(D.seeded(42, c), 1, 1) < "c", "train").otherwise("test")
    pairs = pairs.where("word_sim >= 0.35 and char_sim >= 0.85").withColumns({"split_a": split("a"), "split_b": split("b")})
    return pairs.where("split_a <> split_b").select("a", "b", F.round("char_sim", 9).alias("char_sim"), "split_a", "split_b")


NAMES = ["anger", "joy", "fear", "calm", "doubt"]


@query("select event_id, case user_id % 7 when 0 then 'anger' when 1 then 'joy' when 2 then 'fear' when 3 then 'calm' when 4 then 'doubt' end as \"name\" from events")
def class_names(t):
    return t.events.select("event_id", V.class_name((F.col("user_id") % 7).cast("string"), NAMES).alias("name"))


@query("select avg(case when quality = 1 then 1.0 else 0.0 end) accuracy, count(*) n from labels")
def accuracy(t):
    return t.labels.agg(F.avg((F.col("quality") == 1).cast("double")).alias("accuracy"), F.count("*").alias("n"))


@query("select lang, toxic, quality, count(*) n from documents join labels using (doc_id) group by 1, 2, 3")
def three_way_counts(t):
    return Q.distribution(t.documents.join(t.labels, "doc_id"), "lang", "toxic", "quality")


@query(f"with {near_sql(20, 0.6)} select a, b, round(ws, 9) word_sim, round(cs, 9) char_sim from alike where ws >= 0.35 and cs >= 0.85")
def near_dup_report(t):
    """Pairs of documents alike both in words (0.35) and in characters (0.85)."""
    _, pairs = near(t, words=1.0, ratio=0.6, least=20)
    return pairs.where("word_sim >= 0.35 and char_sim >= 0.85").select("a", "b", F.round("word_sim", 9).alias("word_sim"), F.round("char_sim", 9).alias("char_sim"))


@query("select doc_id, source, quality from documents join labels using (doc_id)")
def manifest_join_back(t):
    """Reviewed rows find their documents by batch and sheet row."""
    sheet = D.batches(t.documents.select("doc_id", "source"), "doc_id", 250)
    reviewed = D.batches(t.labels, "doc_id", 250).select("batch", "excel_row", "quality")
    return sheet.join(reviewed, ["batch", "excel_row"]).select("doc_id", "source", "quality")


# Weights of tags in the fallback order.
WEIGHTS = {"URGENT": 1.0, "SECURITY": 0.9, "MEETING": 0.8, "FINANCIAL": 0.7, "IMPORTANT": 0.6, "GENERAL": 0.4, "PROMOTIONAL": 0.2, "NEWSLETTER": 0.1}


@query(f"with {TAGGED} select id, round(confidence * case tag " + " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.items()) + " else 0.5 end, 9) score from tagged")
def fallback_priority(t):
    rows = Mb.frame(t).withColumn("d", L.tag(L.mail()))
    return rows.select("id", F.round(L.points(F.col("d.tag"), WEIGHTS, 0.5) * F.col("d.confidence"), 9).alias("score"))


# Action names as a model writes them, right and wrong.
NAMED = [" Reply ", "dance", "create_task", "follow_up", "NONE"]
DICTS = "(case turn % 5 " + " ".join(f"when {i} then '{n.strip().lower() if n != 'dance' else 'none'}'" for i, n in enumerate(NAMED)) + " end)"


@query(f"select conv_id, turn, {DICTS} kind, case when conv_id % 3 = 0 then null else length(text) end as \"minutes\" from conversations where text is not null")
def action_dicts(t):
    """Unknown types become none, durations numbers or null."""
    name = F.element_at(F.array(*map(F.lit, NAMED)), (F.col("turn") % len(NAMED) + 1).cast("int"))
    minutes = F.when(F.col("conv_id") % 3 == 0, F.lit("soon")).otherwise(F.length("text").cast("string"))
    rows = t.conversations.where("text is not null").select("conv_id", "turn", F.to_json(F.struct(name.alias("action_type"), minutes.alias("duration_minutes"))).alias("x"))
    p = F.from_json("x", "action_type string, duration_minutes string")
    kind = F.lower(F.trim(F.coalesce(p["action_type"], F.lit("none"))))
    types = ["reply", "create_task", "create_reminder", "create_calendar_event", "review_document", "contact_sender", "follow_up"]
    return rows.select("conv_id", "turn", F.when(kind.isin(*types), kind).otherwise("none").alias("kind"), p["duration_minutes"].try_cast("long").alias("minutes"))
