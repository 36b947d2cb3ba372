"""Canonical rows, violations and label mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import validate as V
from .registry import query

RAW = (
    ("1", "Enron mail", " Hi ", "body", "REQUEST", "High", "0.5", "Human", "en"), ("spam_7", "x", None, " text", "question", "low", "2", None, "fr"), (" ", "phishing set", "s", "", "other", "medium", "abc", "gossip", "xx"),
    ("9", "Synthetic v2", "", "b", "dance", "urgent", "-1", "llm", None), ("5", None, "s", "b", None, None, None, "rules", "de"), ("inbox_3", "SpamAssassin", "s", "b", "meeting", "high", "1", "ground_truth", "unknown"),
)
FIELDS = ("id", "source", "subject", "body", "intent", "priority", "confidence", "label_source", "language")
VALUES = ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in r) + ")" for r in RAW)
CANON = f"""raw as (select * from (values {VALUES}) v({', '.join(FIELDS)})),
one as (select *, trim(coalesce(source, 'synthetic')) src, case when trim(id) = '' then '000000' else trim(id) end rid from raw),
canon as (select case when regexp_matches(rid, '^(enron|spam|phishing|synthetic|inbox)_') then rid when contains(lower(src), 'enron') then 'enron_' || rid when contains(lower(src), 'spam') then 'spam_' || rid when contains(lower(src), 'phishing') then 'phishing_' || rid when contains(lower(src), 'synthetic') then 'synthetic_' || rid else 'inbox_' || rid end id,
trim(coalesce(subject, '')) subject, trim(coalesce(body, '')) body, lower(trim(coalesce(intent, 'other'))) intent, lower(trim(coalesce(priority, 'low'))) priority, src source,
case when lower(coalesce(label_source, 'rules')) in {S.LABEL_SOURCES} then lower(coalesce(label_source, 'rules')) else 'rules' end label_source, greatest(0.0, least(1.0, coalesce(try_cast(confidence as double), 1.0))) label_confidence, coalesce(language, 'en') as "language", contains(lower(src), 'synthetic') is_synthetic from one)"""


def raw(t):
    return t.spark.createDataFrame(RAW, ", ".join(f"{c} string" for c in FIELDS))


@query(f"with {CANON} select * from canon")
def canonicalize(t):
    return V.canonical(raw(t))


@query(f"""with {CANON} select id, array_to_string(list_filter([case when body = '' then 'body: empty' end, case when intent not in {S.INTENTS} then 'intent: unknown' end, case when priority not in {S.PRIORITIES} then 'priority: unknown' end, case when "language" not in {S.LANGUAGES} then 'language: unknown' end], lambda x: x is not null), '; ') errors from canon""")
def violations(t):
    return V.canonical(raw(t)).select("id", F.array_join(V.violations(), "; ").alias("errors"))


@query("select case when contains(lower(source), 'spam') then 'spam_' || doc_id else 'inbox_' || doc_id end id, source from documents")
def namespaced_ids(t):
    return t.documents.select(V.namespaced(F.col("source"), F.col("doc_id").cast("string")).alias("id"), "source")


MAPPED = "select case when o_orderstatus = 'F' then 'ACTION_REQUIRED' when o_orderstatus = 'O' then 'negative' else o_orderpriority end label from orders"
MAP = f"with x as ({MAPPED}) select label, case label when 'ACTION_REQUIRED' then 'request' end intent, case label when 'ACTION_REQUIRED' then '' when 'negative' then 'excluded by mapping' else 'unmapped label' end reason, count(*) n from x group by all"


@query(MAP)
def label_mapping(t):
    """Labels made of order states and priorities, mapped or excluded with the reason."""
    label = F.when(F.col("o_orderstatus") == "F", "ACTION_REQUIRED").when(F.col("o_orderstatus") == "O", "negative").otherwise(F.col("o_orderpriority"))
    rows = t.orders.select(F.lit("Enron").alias("dataset"), label.alias("label"))
    return V.mapped(rows, "dataset", "label").groupBy("label", "intent", "reason").agg(F.count("*").alias("n"))


@query("select user_id, case when value <= 0 then 'value: not positive' when user_id is null then 'user: missing' when value > 300 then 'value: too large' else '' end reason, count(*) n from events where value > 300 or value <= 0 group by 1, 2")
def reject_reasons(t):
    """The first rule that fails names the reason; rows without one are valid."""
    reason = F.when(F.col("value") <= 0, "value: not positive").when(F.col("user_id").isNull(), "user: missing").when(F.col("value") > 300, "value: too large")
    return t.events.withColumn("reason", reason).where("reason is not null").groupBy("user_id", "reason").agg(F.count("*").alias("n"))
