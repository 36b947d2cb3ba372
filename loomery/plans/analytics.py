"""Distributions, confusion metrics, calibration, keyed state and inbox queries over the star schema and events."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import state as S
from ..operators.scan import quantiles
from ..operators.setjoin import top_similar
from ..operators.store import Store
from ..operators.tables import shared_path
from .registry import query

# -- classes: order priority against market segment, event kinds, labels -------------------------------------------

ORDERS = "select o_orderpriority priority, c_mktsegment segment from orders join customer on o_custkey = c_custkey"


def orders(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"))


@query(f"with n as (select priority, count(*) n from ({ORDERS}) group by 1) select priority, n, max(n) over () / n ratio, case when n < 10 then 'rare' when max(n) over () / n > 10 then 'imbalanced' else '' end warning from n")
def class_imbalance(t):
    return Q.imbalance(Q.distribution(orders(t), "priority"))


@query(f"""with n as (select priority, segment, count(*) n from ({ORDERS}) where priority <> '1-URGENT' or segment <> 'BUILDING' group by 1, 2), tot as (select priority, sum(n) total from n group by 1)
select p.priority, s.segment, coalesce(n.n, 0) n, coalesce(n.n, 0) / total share from (select distinct priority from n) p cross join (select distinct segment from n) s left join n on n.priority = p.priority and n.segment = s.segment join tot on tot.priority = p.priority""")
def class_cross_tab(t):
    """Every pair of classes with zeros and the conditional share."""
    return Q.cross_tab(orders(t).where("priority <> '1-URGENT' or segment <> 'BUILDING'"), "priority", "segment")


@query(f"select priority, segment, grouping(priority) g1, grouping(segment) g2, count(*) n from ({ORDERS}) group by cube (priority, segment)")
def split_matrix(t):
    rows = orders(t).cube("priority", "segment").agg(F.grouping("priority").cast("long").alias("g1"), F.grouping("segment").cast("long").alias("g2"), F.count("*").alias("n"))
    return rows.select("priority", "segment", "g1", "g2", "n")


@query("select l_returnflag flag, min(l_quantity) low, max(l_quantity) high, round(avg(l_quantity), 2) mean, median(l_quantity) median, round(quantile_cont(l_extendedprice, 0.95), 6) p95 from lineitem group by 1")
def length_summary(t):
    rows = t.lineitem.withColumnRenamed("l_returnflag", "flag")
    sizes = rows.groupBy("flag").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.avg("l_quantity"), 2).alias("mean"))
    middle = quantiles(rows, ["flag"], F.col("l_quantity"), {"median": 0.5})
    high = quantiles(rows, ["flag"], F.col("l_extendedprice"), {"p95": 0.95}).withColumn("p95", F.round("p95", 6))
    return sizes.join(middle, "flag").join(high, "flag")


PRED = "select d.doc_id, d.lang, d.source, case when l.quality = 1 then 'good' else 'bad' end truth, case when length(d.text) > 400 then 'good' when length(d.text) > 100 then 'bad' else 'unsure' end pred, least(length(d.text) / 1000, 1.0) conf from documents d join labels l using (doc_id)"
PER = """t as (select {g} truth label, sum(case when truth = pred then n else 0 end) tp, sum(n) support from c group by all), p as (select {g} pred label, sum(n) predicted from c group by all),
k as (select {g2} label, coalesce(tp, 0) tp, coalesce(support, 0) support, coalesce(predicted, 0) predicted from t {join} join p using ({u} label)),
m as (select *, case when predicted > 0 then tp / predicted else 0.0 end as "precision", case when support > 0 then tp / support else 0.0 end recall from k),
f as (select *, case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) else 0.0 end f1 from m)"""


def predictions(t):
    """A length rule as the prediction, quality as the truth, and the length as the confidence."""
    n = F.length("text")
    pred = F.when(n > 400, "good").when(n > 100, "bad").otherwise("unsure")
    return t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "source", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), pred.alias("pred"), F.least(n / 1000, F.lit(1.0)).alias("conf"))


@query(f"select truth as true, pred, count(*) n from ({PRED}) group by 1, 2".replace("as true", 'as "true"'))
def confusion_matrix(t):
    return M.confusion(predictions(t), "truth", "pred")


def per(g: str, join: str) -> str:
    return f"with c as (select {g} truth, pred, count(*) n from ({PRED}) group by all), " + PER.format(g=g, g2=g, u=g, join=join)


@query(per("", "full") + ' select label, cast(tp as bigint) tp, cast(support as bigint) support, cast(predicted as bigint) predicted, cast("precision" as double) "precision", cast(recall as double) recall, cast(f1 as double) f1 from f')
def head_metrics(t):
    return M.per_class(M.confusion(predictions(t), "truth", "pred"))


def overall(g: str, join: str, keys: str) -> str:
    return per(g, join) + f" select {keys} cast(sum(support) as bigint) n, sum(tp) / sum(support) accuracy, avg(f1) macro_f1, sum(f1 * support) / sum(support) weighted_f1, max(support) / sum(support) majority from f group by all"


@query(overall("", "full", ""))
def macro_f1_union(t):
    return M.summary(M.per_class(M.confusion(predictions(t), "truth", "pred")))


@query(overall("", "left", ""))
def macro_f1_true_only(t):
    return M.summary(M.per_class(M.confusion(predictions(t), "truth", "pred"), universe="true"))


@query(overall("lang,", "full", "lang,"))
def metrics_by_language(t):
    return M.summary(M.per_class(M.confusion(predictions(t), "truth", "pred", "lang"), "lang"), "lang")


@query(f"select lang, count(*) n, avg(case when truth = pred then 1.0 else 0.0 end) accuracy from ({PRED}) group by grouping sets ((lang), ())")
def metrics_grouping_sets(t):
    p = predictions(t)
    return p.rollup("lang").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))


@query(f"with e as (select truth, pred, conf, doc_id, row_number() over (partition by truth, pred order by doc_id) r from ({PRED}) where truth <> pred), tot as (select truth, count(*) total from ({PRED}) group by 1) select truth, pred, count(*) n, count(*) / any_value(total) share, round(avg(conf), 4) mean_confidence, array_to_string(list(doc_id order by doc_id) filter (where r <= 5), ',') samples from e join tot using (truth) group by 1, 2")
def failure_modes(t):
    """Error pairs with their share of the true class, mean confidence and five samples."""
    p = predictions(t)
    total = p.groupBy("truth").agg(F.count("*").alias("total"))
    w = Window.partitionBy("truth", "pred").orderBy("doc_id")
    bad = p.where("truth <> pred")
    sample = bad.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("truth", "pred").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("samples"))
    n = bad.groupBy("truth", "pred").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 4).alias("mean_confidence"))
    return n.join(sample, ["truth", "pred"]).join(total, "truth").select("truth", "pred", "n", (F.col("n") / F.col("total")).alias("share"), "mean_confidence", "samples")


CONF = "select event_id, event_type, least(value / 200, 1.0) conf, cast(regexp_extract(props, '\\d+') as bigint) % 2 = 0 correct from events"


def scored(t):
    return t.events.select("event_id", "event_type", F.least(F.col("value") / 200, F.lit(1.0)).alias("conf"), (F.regexp_extract("props", r"\d+", 0).cast("long") % 2 == 0).alias("correct"))


@query(f"with b as (select cast(least(floor(conf * 10), 9) as int) bin, count(*) n, avg(cast(correct as double)) accuracy, avg(conf) confidence from ({CONF}) group by 1) select bin, n, accuracy, round(confidence, 9) confidence, round(abs(accuracy - confidence), 9) gap, round(abs(accuracy - confidence) * n / sum(n) over (), 9) ece_part from b")
def ece_bins(t):
    b = M.calibration(scored(t), F.col("conf"), F.col("correct"))
    return b.select("bin", "n", "accuracy", *(F.round(c, 9).alias(c) for c in ("confidence", "gap", "ece_part")))


@query(f"select event_type, round(avg(pow(conf - cast(correct as int), 2) + pow((1 - conf) - (1 - cast(correct as int)), 2)), 9) brier from ({CONF}) group by 1")
def brier_score(t):
    y = F.col("correct").cast("int")
    return scored(t).groupBy("event_type").agg(F.round(F.avg(F.pow(F.col("conf") - y, 2) + F.pow((1 - F.col("conf")) - (1 - y), 2)), 9).alias("brier"))


BUCKET = "case " + " ".join(f"when conf >= {a} and conf <= {b} then '{n}'" for n, a, b in M.BUCKETS) + " end"


@query(f"select {BUCKET} as bucket, count(*) n, avg(cast(correct as double)) accuracy, round(avg(conf), 9) mean_confidence from ({CONF}) group by 1")
def confidence_buckets(t):
    return scored(t).groupBy(M.bucket(F.col("conf")).alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.round(F.avg("conf"), 9).alias("mean_confidence"))


@query(f"""with th(threshold) as (values (0.30), (0.35), (0.40), (0.45), (0.50), (0.55)), g as (select cast(threshold as double) threshold, sum(case when conf >= threshold and correct then 1 else 0 end) tp, sum(case when conf >= threshold then 1 else 0 end) predicted, sum(case when correct then 1 else 0 end) pos from ({CONF}), th group by 1),
m as (select threshold, cast(tp as bigint) tp, cast(predicted as bigint) predicted, tp / predicted as "precision", tp / pos recall from g) select *, 2 * "precision" * recall / ("precision" + recall) f1 from m""")
def threshold_sweep(t):
    return M.sweep(scored(t), F.col("conf"), F.col("correct"), [0.30, 0.35, 0.40, 0.45, 0.50, 0.55])


@query("select event_type, avg(value) mean, median(value) median, round(quantile_cont(value, 0.95), 9) p95 from events group by 1")
def latency_percentiles(t):
    mean = t.events.groupBy("event_type").agg(F.avg("value").alias("mean"))
    return mean.join(quantiles(t.events, ["event_type"], F.col("value"), {"median": 0.5, "p95": 0.95}), "event_type").withColumn("p95", F.round("p95", 9))


@query(f"""with a as (select truth label, avg(case when truth = pred then 1.0 else 0.0 end) recall from ({PRED}) group by 1), b as (select truth label, avg(case when truth = 'good' then 1.0 else 0.0 end) recall from ({PRED}) group by 1)
select label, coalesce(b.recall, 0) - coalesce(a.recall, 0) delta, case when coalesce(b.recall, 0) - coalesce(a.recall, 0) > 0.01 then 'better' when coalesce(b.recall, 0) - coalesce(a.recall, 0) < -0.01 then 'worse' else 'same' end verdict from a full join b using (label)""")
def model_compare(t):
    """Recall of the length rule and of the majority rule, per class, with deltas beyond 0.01 named."""
    p = predictions(t)
    a = p.groupBy(F.col("truth").alias("label")).agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("a"))
    b = p.groupBy(F.col("truth").alias("label")).agg(F.avg((F.col("truth") == "good").cast("double")).alias("b"))
    d = F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))
    return a.join(b, "label", "full").select("label", d.alias("delta"), F.when(d > 0.01, "better").when(d < -0.01, "worse").otherwise("same").alias("verdict"))


# -- keyed state ---------------------------------------------------------------------------------------------------


@query("select conv_id, turn, array_to_string(list_transform(coalesce(list(text) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding), []), lambda x: substr(x, 1, 20)), '|') context from conversations")
def context_last3(t):
    rows = S.with_context(t.conversations, ["conv_id"], ["turn"], "text")
    return rows.select("conv_id", "turn", F.array_join(F.transform("context", lambda x: F.substring(x, 1, 20)), "|").alias("context"))


@query("select conv_id, turn, recency from (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) recency from conversations) where recency <= 4")
def history_topn(t):
    return S.last_n(t.conversations.select("conv_id", "turn"), ["conv_id"], ["turn"], 4).withColumn("recency", F.col("recency").cast("long"))


@query("""with w as (select conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^\\w\\p{L}]+'), lambda x: x <> '')) w from conversations)
select a.conv_id, a.turn, coalesce(bool_or(len(list_intersect(a.w, b.w)) >= 2), false) follow_up from w a left join w b on a.conv_id = b.conv_id and b.turn < a.turn and b.turn >= a.turn - 3 group by 1, 2""")
def follow_up_overlap(t):
    rows = S.with_context(t.conversations, ["conv_id"], ["turn"], "text")
    return rows.select("conv_id", "turn", S.shares_words(F.col("text"), F.col("context")).alias("follow_up"))


@query("""with p as (select conv_id, turn, cast(contains(lower(text), 'the') as int) + cast(contains(lower(text), 'need') as int) now_n from conversations)
select conv_id, turn, now_n > coalesce(lag(now_n) over (partition by conv_id order by turn), 0) escalated from p""")
def urgency_escalation(t):
    """Pressure words of this turn against the one before, with words that the corpus has."""
    n = sum((F.lower("text").contains(w).cast("int") for w in ("the", "need")), F.lit(0))
    before = F.lag("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("n", n).select("conv_id", "turn", (F.col("n") > F.coalesce(before, F.lit(0))).alias("escalated"))


@query("select event_id, user_id from events where ts > (select max(ts) from events) - interval 7 days")
def recent_activity(t):
    top = t.events.agg(F.max("ts").alias("asof"))
    return t.events.crossJoin(F.broadcast(top)).where(F.col("ts") > F.col("asof") - F.expr("interval 7 days")).select("event_id", "user_id")


@query("select user_id, count(*) kept from events where ts > (select max(ts) from events) - interval 30 days group by 1")
def retention(t):
    top = t.events.agg(F.max("ts").alias("asof"))
    return t.events.crossJoin(F.broadcast(top)).where(F.col("ts") > F.col("asof") - F.expr("interval 30 days")).groupBy("user_id").agg(F.count("*").alias("kept"))


REWARD = "greatest(-1.0, least(1.0, (value - 50) / 50))"


def reward():
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 50))


@query(f"""with r as (select event_type, {REWARD} r, row_number() over (partition by event_type order by ts desc, event_id desc) - 1 k from events) select event_type, round(sum(r * 0.1 * pow(0.9, k)), 9) q, count(*) n from r group by 1""")
def q_fold(t):
    out = S.q_fold(t.events, "event_type", ["ts", "event_id"], reward())
    return out.select("event_type", F.round("q", 9).alias("q"), "n")


@query(f"select event_id, round(avg(case when {REWARD} > 0 then 1.0 else 0.0 end) over (partition by event_type order by ts, event_id rows unbounded preceding), 9) running_rate from events")
def running_feedback(t):
    out = S.running_rate(t.events, ["event_type"], ["ts", "event_id"], reward())
    return out.select("event_id", F.round("running_rate", 9).alias("running_rate"))


def counters_sql(key: str) -> str:
    return f"with x as (select {key}, {REWARD} s from events), g as (select {key}, count(*) total, cast(count(*) filter (where s > 0) as bigint) positive, cast(count(*) filter (where s < 0) as bigint) negative, cast(count(*) filter (where s = 0) as bigint) neutral from x group by 1) select *, positive / total rate, (positive - negative) / total average from g"


@query(counters_sql("event_type"))
def feedback_by_platform(t):
    return S.counters(t.events, ["event_type"], reward())


@query(counters_sql("user_id"))
def feedback_by_user(t):
    return S.counters(t.events, ["user_id"], reward())


@query(f"""with a as (select max(ts) at_ from events), x as (select at_ - ts age, case when {REWARD} > 0 then 1.0 else 0.0 end s from events, a), g as (select coalesce(avg(s) filter (where age < interval 7 days), 0) recent, coalesce(avg(s) filter (where age >= interval 7 days and age < interval 14 days), 0) previous from x)
select cast(recent as double) recent, cast(previous as double) previous, round(recent - previous, 12) trend, case when recent - previous > 0.05 then 'improving' when recent - previous < -0.05 then 'declining' else 'stable' end direction from g""")
def feedback_trend(t):
    out = S.trend(t.events, "ts", reward(), t.events.agg(F.max("ts").alias("asof")))
    return out.select("recent", "previous", F.round("trend", 12).alias("trend"), "direction")


@query(f"with c as ({counters_sql('event_type')}) select event_type, 'improve' suggestion from c where average < 0 union all select event_type, 'raise satisfaction' from c where rate < 0.6 union all select event_type, 'collect more' from c where total < 10")
def feedback_suggestions(t):
    c = S.counters(t.events, ["event_type"], reward())
    what = F.array_compact(F.array(F.when(F.col("average") < 0, "improve"), F.when(F.col("rate") < 0.6, "raise satisfaction"), F.when(F.col("total") < 10, "collect more")))
    return c.select("event_type", F.explode(what).alias("suggestion"))


URGENCY = "case when value > 150 then 'high' when value > 50 then 'medium' else 'low' end"


def most(name: str, what: str) -> str:
    return f"{name} as (select user_id, min(x) {name} from (select user_id, {what} x, count(*) n, max(count(*)) over (partition by user_id) top from events group by 1, 2) where n = top group by 1)"


@query(f"""with {most("mode_event_type", "event_type")}, {most("mode_urgency", URGENCY)}
select user_id, count(*) messages, count(*) filter (where ts > (select max(ts) from events) - interval 7 days) recent, min(ts) first_seen, max(ts) last_seen, any_value(mode_event_type) mode_event_type, any_value(mode_urgency) mode_urgency,
round(avg(value), 1) mean_length, case when avg(value) < 50 then 'concise' when avg(value) < 150 then 'moderate' else 'detailed' end style, round(100 * avg(case when cast(regexp_extract(props, '\\d+') as bigint) % 2 = 0 then 1.0 else 0.0 end), 6) context_rate
from events join mode_event_type using (user_id) join mode_urgency using (user_id) group by 1""")
def user_analytics(t):
    """Counts, recent activity, most common kind and urgency, style by mean length, and how often context was used (even marks)."""
    top = t.events.agg(F.max("ts").alias("asof"))
    urgency = F.when(F.col("value") > 150, "high").when(F.col("value") > 50, "medium").otherwise("low")
    e = t.events.withColumn("urgency", urgency)
    used = (F.regexp_extract("props", r"\d+", 0).cast("long") % 2 == 0).cast("double")
    g = e.crossJoin(F.broadcast(top)).groupBy("user_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("ts") > F.col("asof") - F.expr("interval 7 days")).alias("recent"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        S.mean("value").alias("v"), F.round(100 * F.avg(used), 6).alias("context_rate"),
    )
    style = F.when(F.col("v") < 50, "concise").when(F.col("v") < 150, "moderate").otherwise("detailed")
    g = g.join(S.mode(e, ["user_id"], "event_type"), "user_id").join(S.mode(e, ["user_id"], "urgency"), "user_id")
    return g.select("user_id", "messages", "recent", "first_seen", "last_seen", "mode_event_type", "mode_urgency", F.round("v", 1).alias("mean_length"), style.alias("style"), "context_rate")


@query("select count(*) total, count(distinct user_id) users, count(distinct event_type) kinds, count(distinct cast(ts as date)) sessions, min(ts) first_ts, max(ts) last_ts from events")
def store_statistics(t):
    return t.events.agg(F.count("*").alias("total"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"), F.countDistinct(F.to_date("ts")).alias("sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("select round(avg(r), 9) mean_reward, count(*) n from (select " + REWARD + " r from events order by ts desc, event_id desc limit 100)")
def recent_rewards(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).agg(F.round(F.avg(reward()), 9).alias("mean_reward"), F.count("*").alias("n"))


@query("select event_type, count(*) n, count(*) / sum(count(*)) over () share from events group by 1")
def action_usage(t):
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("event_type", "n", (F.col("n") / F.col("total")).alias("share"))


@query("select user_id, arg_max(event_type, struct_pack(ts, event_id)) preferred, count(*) corrections, count(distinct event_type) tags from events group by 1")
def sender_insights(t):
    """Last write wins: the newest tag of each sender, without a sort."""
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("preferred"), F.count("*").alias("corrections"), F.countDistinct("event_type").alias("tags"))


@query("select event_id, event_type from events where event_id % 2 = 0 union all select event_id, event_type from events where event_id % 3 = 0 and event_id % 2 <> 0")
def import_anti_join(t):
    """A store and an import that overlap: rows of the import that the store lacks are added."""
    e = t.events.select("event_id", "event_type")
    return S.anti_merge(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["event_id"])


@query("""with newest as (select max(ts) top from events), v as (select event_id, ts, user_id, value, 1 k from events where event_id % 2 = 0 union all select event_id, ts, user_id, value + 1, 2 from events where event_id % 10 = 0),
n as (select * from v qualify row_number() over (partition by event_id order by ts desc, k desc) = 1), kept as (select event_id, ts, user_id, value from n, newest where ts >= top - interval 30 days),
i as (select event_id, ts, user_id, value from events, newest where event_id % 3 = 0 and event_id not in (select event_id from kept))
select * from kept union all select * from i""")
def store_lifecycle(t):
    """A stored table: rows, newer versions of some, expiry after 30 days, an import that adds what the store lacks, compaction."""
    rows = t.events.select("event_id", "ts", "user_id", "value")
    store = Store(t.spark, shared_path(t.spark, f"store_{uuid.uuid4().hex}"), ["event_id"], "ts", buckets=16)
    store.merge(rows.where("event_id % 2 = 0"))
    store.merge(rows.where("event_id % 10 = 0").withColumn("value", F.col("value") + 1))
    store.expire(rows.agg(F.max("ts") - F.expr("interval 30 days")).first()[0])
    store.merge(rows.where("event_id % 3 = 0"), only_new=True)
    store.compact()
    store.vacuum()
    return store.read()


# -- inbox ---------------------------------------------------------------------------------------------------------


@query("select o_orderkey, round(o_totalprice + coalesce(q, 0), 6) score from (select *, case when o_orderpriority = '1-URGENT' then 1000.0 when o_orderpriority = '2-HIGH' then 500.0 end q from orders)")
def inbox_ranked(t):
    """Base score and learned value by a left join on the state key, highest first, ties by key."""
    q = t.spark.createDataFrame([("1-URGENT", 1000.0), ("2-HIGH", 500.0)], "o_orderpriority string, q double")
    out = t.orders.join(q, "o_orderpriority", "left").select("o_orderkey", F.round(F.col("o_totalprice") + F.coalesce("q", F.lit(0.0)), 6).alias("score"))
    return out.orderBy(F.desc("score"), "o_orderkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 20")
def inbox_page(t, page: int = 3, size: int = 10):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset((page - 1) * size).limit(size)


@query("select * from (select 'score' mode, o_orderkey from orders order by o_totalprice desc, o_orderkey limit 5) union all select * from (select 'date' mode, o_orderkey from orders order by o_orderdate desc, o_orderkey limit 5) union all select * from (select 'sender' mode, o_orderkey from orders order by o_custkey, o_orderkey limit 5)")
def sort_modes(t):
    o = t.orders
    top = lambda name, *by: o.orderBy(*by, "o_orderkey").limit(5).select(F.lit(name).alias("mode"), "o_orderkey")
    return top("score", F.desc("o_totalprice")).unionAll(top("date", F.desc("o_orderdate"))).unionAll(top("sender", "o_custkey"))


@query("""with w as (select conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) w from conversations), q as (select w qw from w where conv_id = 0 and turn = 0),
s as (select conv_id, turn, len(list_intersect(w, qw)) / (len(w) + len(qw) - len(list_intersect(w, qw))) score from w, q) select conv_id, turn, round(score, 9) score from s where score > 0.02 order by score desc, conv_id, turn limit 5""")
def similarity_search(t):
    """One query text against the history, top 5: the query is one row."""
    c = t.conversations.select("conv_id", "turn", sim.word_set(F.lower("text")).alias("w"))
    q = c.where("conv_id = 0 and turn = 0").select(F.col("w").alias("qw")).limit(1)
    s = c.crossJoin(F.broadcast(q)).select("conv_id", "turn", sim.jaccard(F.col("w"), F.col("qw")).alias("score")).where("score > 0.02")
    return s.orderBy(F.desc("score"), "conv_id", "turn").limit(5).withColumn("score", F.round("score", 9))


@query("""with w as (select conv_id * 100000 + turn id, conv_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) w from conversations),
s as (select q.id query_id, h.id, len(list_intersect(q.w, h.w)) i, len(q.w) + len(h.w) n from w q join w h on q.conv_id % 50 = 0 and q.id <> h.id),
r as (select query_id, id, i / (n - i) score, row_number() over (partition by query_id order by i / (n - i) desc, id) rank from s where i / (n - i) > 0.1)
select query_id, id, round(score, 9) score, rank from r where rank <= 5""")
def similar_turns(t):
    """The five most similar turns of the whole history, above 0.1, for every turn of each fiftieth conversation."""
    rows = t.conversations.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "conv_id", sim.word_set(F.lower("text")).alias("s"))
    top = top_similar(rows.where("conv_id % 50 = 0"), rows, 5)
    return top.select(F.col("q").alias("query_id"), F.col("h").alias("id"), F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))
