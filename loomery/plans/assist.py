"""Chat intents, languages, actions, model labels, prompts and the remaining reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import analysis as A
from ..functions import lexicon as L
from ..functions import text as X
from ..operators import dedup as D
from ..operators import metrics as M
from ..operators import state as St
from . import mailbox as Mb
from .analytics import PRED, predictions
from .registry import SQL, query
from .rules import TAGGED, case, found, hits, lit


def total(patterns) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all(b, {lit(p)}))" for p in patterns) + ")"


CHAT = [(found("b", A.REQUESTS) + " > 0", "'request'", "0.9"), (found("b", A.SOCIAL) + " > 0", "'social'", "0.9"), (f"ends_with(b, '?') and regexp_matches(b, {lit(A.QUESTION_START)})", "'question'", "0.9")]
CHAT += [(total(p) + " > 0", f"'{k}'", f"least(1.0, 0.65 + {total(p)} * 0.1)") for k, p in A.CHAT_RULES.items()]
URG = [(hits("b", w) + " > 0", f"'{k}'", str(c)) for k, (w, c) in A.CHAT_URGENCY.items()]
URG += [("length(b) < 50", "'low'", "0.4"), (f"contains(b, '?') or {hits('b', ['need', 'want', 'require'])} > 0", "'medium'", "0.5")]
CHAT_SQL = f"{case([(t, k) for t, k, _ in CHAT], lit('informational'))} intent, round(cast({case([(t, c) for t, _, c in CHAT], '0.3')} as double), 9) intent_confidence, {case([(t, k) for t, k, _ in URG], lit('low'))} urgency, cast({case([(t, c) for t, _, c in URG], '0.3')} as double) urgency_confidence"


@query(f"with {Mb.SQL}, x as (select id, trim(lower(body), ' ' || chr(10)) b from mail) select id, {CHAT_SQL} from x")
def chat_intents(t):
    rows = Mb.frame(t).withColumns({"i": A.chat_intent("body"), "u": A.chat_urgency("body")})
    return rows.select("id", "i.intent", F.round("i.confidence", 9).alias("intent_confidence"), "u.urgency", F.col("u.confidence").alias("urgency_confidence"))


MARK = {k: "(len(list_intersect(w, [" + ", ".join(map(lit, m)) + f"])) / {len(m)})" for k, m in A.MARKERS.items()}
TOPM = "greatest(" + ", ".join(MARK) + ")"


@query(f"with w as (select doc_id, lang, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) c, list_distinct(string_split_regex(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')) w from documents), s as (select doc_id, lang, length(c) n, " + ", ".join(f"{v} {k}" for k, v in MARK.items()) + f" from w), d as (select doc_id, lang, case when n >= 20 and {TOPM} > 0 then " + case([(f"{k} = {TOPM}", lit(k)) for k in list(MARK)[:-1]], lit(list(MARK)[-1])) + f" else 'unknown' end as guess, case when n >= 20 then {TOPM} else 0.0 end score from s) select doc_id, guess, round(score, 9) score, guess <> lang disagrees from d")
def language_markers(t):
    """Marker words against the stored language, with the disagreement flag."""
    rows = t.documents.withColumn("g", A.language_of("text"))
    return rows.select("doc_id", F.col("g.language").alias("guess"), F.round("g.score", 9).alias("score"), (F.col("g.language") != F.col("lang")).alias("disagrees"))


@query(f"""with {Mb.SQL}, x as (select id, trim(trim(subject) || ' ' || trim(body)) t, trim(body) b, trim(subject) s, lower(trim(subject) || ' ' || trim(body)) l from mail)
select id, case when {hits('l', ['meeting', 'calendar'])} > 0 then 'meeting' when {hits('l', ['please', 'can you'])} > 0 then 'request' when contains(t, '?') then 'question' else 'information' end intent, case when {hits('l', ['urgent', 'asap', 'immediately'])} > 0 then 'high' else 'medium' end urgency, case when {hits('l', ['problem', 'failed', 'angry'])} > 0 then 'negative' else 'neutral' end sentiment, md5(substr(b, 1, 180) || case when length(b) > 180 then '...' else '' end) summary from x""")
def mock_analysis(t):
    return Mb.frame(t).withColumn("a", A.mock_analysis("subject", "body")).select("id", "a.intent", "a.urgency", "a.sentiment", F.md5("a.summary").alias("summary"))


INTENT_OF = "case when id % 5 = 0 then 'meeting' when id % 5 = 1 then 'request' when id % 5 = 2 then 'question' when id % 5 = 3 then 'promotion' else 'follow_up' end"


@query(f"""with {Mb.SQL}, x as (select id, lower(subject) s, lower(body) b, {INTENT_OF} i from mail) select id, case when i = 'meeting' or {hits('s', ['meeting', 'schedule'])} > 0 then 'create_calendar_event' when i = 'question' or contains(s, 'reply') or contains(b, 'can you') then 'reply' when i = 'promotion' then 'none' when i = 'follow_up' then 'follow_up' when {hits('b', ['submit', 'reset', 'verify', 'pay', 'send', 'approve'])} > 0 then 'create_task' else 'reply' end action from x""")
def action_cascade(t):
    i = F.element_at(F.array(*map(F.lit, ["meeting", "request", "question", "promotion", "follow_up"])), (F.col("id") % 5 + 1).cast("int"))
    return Mb.frame(t).select("id", A.expected_action(i, F.col("subject"), F.col("body")).alias("action"))


# Model texts that the parser has to tell apart.
RAW = ["reply to Ann", "action_type: create_task", "No action needed", "calendar for tomorrow", "respond soon", "something else", "review_document: contract", "follow up", "", "create_reminder"]
RAWSQL = "r(k, raw) as (values " + ", ".join(f"({i}, {lit(x)})" for i, x in enumerate(RAW)) + ")"
KIND = case([(f"starts_with(raw, '{a}') or contains(raw, 'action_type: {a}') or contains(raw, 'action: {a}')", lit(a)) for a in A.ACTION_TYPES] + [(hits("raw", A.NO_ACTION) + " > 0", "'none'")] + [(f"starts_with(raw, '{s}')", lit(a)) for a, s in A.ACTION_STARTS], "'none'")


@query(f"with {Mb.SQL}, {RAWSQL}, x as (select id, lower(raw) raw, subject || ' ' || body t from mail join r on id % 10 = k) select id, {KIND} kind, case when {KIND} <> 'none' then nullif(regexp_extract(t, {lit('(?i)' + A.DAY)}), '') end as due_day, case when {KIND} <> 'none' then nullif(regexp_extract(t, {lit('(?i)' + A.HOUR)}), '') end due_hour from x")
def action_parse(t):
    raw = F.element_at(F.array(*map(F.lit, RAW)), (F.col("id") % 10 + 1).cast("int"))
    rows = Mb.frame(t).withColumn("p", A.parsed_action(raw, F.concat("subject", F.lit(" "), "body")))
    return rows.select("id", F.col("p.type").alias("kind"), F.col("p.day").alias("due_day"), F.col("p.hour").alias("due_hour"))


FACTS = "list_sort(list_distinct(" + "list_concat(" * (len(A.FACTS) - 1) + f"regexp_extract_all(body, {lit('(?i)' + A.FACTS[0])})" + "".join(f", regexp_extract_all(body, {lit('(?i)' + p)}))" for p in A.FACTS[1:]) + "))"


@query(f"with {Mb.SQL} select id, array_to_string({FACTS}, '|') facts, case when len({FACTS}) = 0 then 1.0 else len(list_filter({FACTS}, lambda x: contains(lower(substr(body, 1, 40)), lower(x)))) / len({FACTS}) end kept from mail")
def key_facts(t):
    """Amounts, shares and dates, and how many a summary (the head) keeps."""
    return Mb.frame(t).select("id", F.array_join(A.facts("body"), "|").alias("facts"), A.kept_facts(F.col("body"), F.substring("body", 1, 40)).alias("kept"))


# Responses of a model, good and bad.
RESPONSES = ['{"intent": "Request", "priority": "high", "confidence": 0.8}', '{"intent": "dance", "priority": "low"}', '{"intent": "meeting", "priority": "soon"}', '{"intent": "meeting", "priority": "low", "confidence": "x"}', '{"intent": "question", "priority": "medium", "confidence": 1.5}', '{"intent": "other", "priority": "low"}']


@query(f"with r(id, p) as (values " + ", ".join(f"(cast({i} as bigint), {lit(x)})" for i, x in enumerate(RESPONSES)) + f"), x as (select id, lower(trim(p->>'intent')) intent, lower(trim(p->>'priority')) priority, coalesce(p->>'confidence', '0') c from r) select id, intent, priority, try_cast(c as double) confidence, case when intent not in {S.INTENTS} then 'intent' when priority not in {S.PRIORITIES} then 'priority' when try_cast(c as double) is null then 'confidence: not a number' when not try_cast(c as double) between 0 and 1 then 'confidence: range' end error from x")
def model_labels(t):
    rows = t.spark.createDataFrame(list(enumerate(RESPONSES)), "id long, p string")
    return rows.withColumn("l", A.model_label("p", S.INTENTS, S.PRIORITIES)).select("id", "l.*")


@query(f"with {Mb.SQL}, x as (select id, case when id % 3 = 0 then 'request' else 'meeting' end i, case when id % 2 = 0 then 'request' else 'meeting' end ri, 'high' p, case when id % 4 = 0 then null when id % 4 = 1 then 'high' else 'low' end rp from mail) select id, case when i = ri and (rp is null or p = rp) then 'agreement' else concat_ws('; ', case when ri <> i then 'intent ' || i || ' over ' || ri end, case when rp is not null and rp <> p then 'priority ' || p || ' over ' || rp end) end reason from x")
def label_resolution(t):
    pick = lambda n, test, a, b: F.when(F.col("id") % n == test, a).otherwise(b)
    rp = F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, "high").otherwise("low")
    return Mb.frame(t).select("id", A.resolution(pick(3, 0, "request", "meeting"), pick(2, 0, "request", "meeting"), F.lit("high"), rp).alias("reason"))


@query("select event_id, date_trunc('second', cast(ts as timestamp)) - case when event_id % 4 = 1 then interval 2 hour else interval 0 hour end as \"at\", case when event_id % 5 = 4 then null else date_trunc('second', cast(ts as timestamp)) + case when event_id % 5 = 2 then interval 5 hour else interval 0 hour end end mailed from events")
def timestamps(t):
    """Times written as ISO 8601 with Z, an offset or none, and as mail dates with and without zones, parsed again."""
    ts, k, j = F.date_trunc("second", F.col("ts").cast("timestamp")), F.col("event_id") % 4, F.col("event_id") % 5
    iso, mail = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, "d MMM yyyy HH:mm:ss")
    a = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+02:00"))).when(k == 2, iso).otherwise("never")
    m = F.when(j == 0, F.concat(F.date_format(ts, "EEE, "), mail, F.lit(" GMT"))).when(j == 1, mail).when(j == 2, F.concat(mail, F.lit(" -0500 (EST)"))).when(j == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("never")
    rows = t.events.select("event_id", ts.alias("ts"), a.alias("a"), m.alias("m"))
    return rows.select("event_id", A.iso_time("a", F.col("ts")).alias("at"), A.mail_time(F.col("m")).alias("mailed"))


@query("select doc_id, md5('Summarize.' || chr(10) || chr(10) || case when source is null then '' else '[Category: ' || source || ']' || chr(10) end || 'Body: ' || case when length(text) > 1500 then substr(text, 1, 1500) || '... [truncated]' else text end || chr(10) || chr(10) || 'Summary:') prompt from documents where text is not null")
def prompts(t):
    p = A.prompt("Summarize.", F.lit(""), F.col("text"), F.col("source"), F.lit(None).cast("string"), "Summary:")
    return t.documents.where("text is not null").select("doc_id", F.md5(p).alias("prompt"))


# Emoji put behind texts; the mood of each with the glad ones first, then the sad ones, then others.
EMO = [("", "none"), ("😊", "positive"), ("😡", "negative"), ("😊😡", "positive"), ("⭐", "neutral"), ("❌", "negative")]


@query("select conv_id, turn, case turn % 6 " + " ".join(f"when {i} then '{m}'" for i, (_, m) in enumerate(EMO)) + " end mood, case when (conv_id % 5 - 2) / 10.0 > 0.1 then 'positive' when (conv_id % 5 - 2) / 10.0 < -0.1 then 'negative' else 'neutral' end label from conversations")
def sentiments(t):
    """Mood by emoji and the label of a polarity."""
    mark = F.element_at(F.array(*(F.lit(e) for e, _ in EMO)), (F.col("turn") % len(EMO) + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", A.emoji_sentiment(F.concat(F.coalesce("text", F.lit("")), mark)).alias("mood"), A.sentiment_label((F.col("conv_id") % 5 - 2) / 10.0).alias("label"))


@query("select event_id, case when event_type = 'click' then greatest(0.1, least(value / 200, 1.0) * case when value < 50 then 0.6 else 0.7 end) else least(1.0, least(value / 200, 1.0) * case when value > 50 then 1.2 else 1.1 end) end confidence from events")
def confidence_feedback(t):
    return t.events.select("event_id", A.corrected_confidence(F.least(F.col("value") / 200, F.lit(1.0)), F.col("event_type") == "click", F.col("value") - 50).alias("confidence"))


@query("with p as (select event_id, least(value / 200, 1.0) p from events) select event_id, case when p >= 0.45 then 'high' when 1 - p >= 0.8 then 'low' else 'medium' end tier from p")
def high_policy(t):
    """The high class at its own threshold, else the most probable of the others."""
    p = F.least(F.col("value") / 200, F.lit(1.0))
    return t.events.select("event_id", F.when(p >= 0.45, "high").when(1 - p >= 0.8, "low").otherwise("medium").alias("tier"))


# -- reports ---------------------------------------------------------------------------------------------------------


@query("select source = 'src0' synthetic, quality, count(*) n, count(*) / sum(count(*)) over (partition by source = 'src0') share from documents join labels using (doc_id) group by 1, 2")
def synthetic_report(t):
    g = t.documents.join(t.labels, "doc_id").groupBy((F.col("source") == "src0").alias("synthetic"), "quality").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("synthetic")))


@query(f"""with e as (select *, row_number() over (partition by lang, truth, pred order by doc_id) r from ({PRED}) where truth <> pred)
select lang, truth, pred, count(*) n, array_to_string(list(doc_id order by doc_id) filter (where r <= 3), ',') samples from e group by all order by n desc, lang, truth, pred limit 20""")
def top_confusions(t):
    """The twenty most frequent confusions with three samples each."""
    bad, keys = predictions(t).where("truth <> pred"), ["lang", "truth", "pred"]
    top = bad.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(20)
    first = bad.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id"))).where("r <= 3")
    sample = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("samples"))
    return sample.join(F.broadcast(top), keys).select(*keys, "n", "samples")


@query("""select doc_id, field from (select doc_id, unnest(list_filter([case when quality = 1 and length(text) < 100 then 'short but good' end, case when quality = 0 and length(text) > 2000 then 'long but bad' end, case when toxic = 1 and quality = 1 then 'toxic but good' end,
case when quality = 0 and contains(text, '?') then 'question but bad' end, case when quality = 1 and 10 * len(regexp_extract_all(text, '[#*$%&|<>]')) > length(text) then 'symbols but good' end], lambda x: x is not null)) field from documents join labels using (doc_id)) order by doc_id, field limit 30""")
def label_conflicts(t):
    """Five rules that name a doubtful label, 30 cases for a reader."""
    n, good, bad = F.length("text"), F.col("quality") == 1, F.col("quality") == 0
    symbols = 10 * F.regexp_count("text", F.lit("[#*$%&|<>]")) > n
    rules = {"short but good": good & (n < 100), "long but bad": bad & (n > 2000), "toxic but good": good & (F.col("toxic") == 1), "question but bad": bad & F.contains("text", F.lit("?")), "symbols but good": good & symbols}
    tests = F.array_compact(F.array(*(F.when(test, name) for name, test in rules.items())))
    return t.documents.join(t.labels, "doc_id").select("doc_id", F.explode(tests).alias("field")).orderBy("doc_id", "field").limit(30)


@query("select event_type, count(*) n, array_to_string(list(event_id order by ts desc, event_id desc) filter (where r <= 5), ',') latest from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) r from events) group by 1")
def platform_summary(t):
    """Feedback of a platform with its five newest entries."""
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    last = St.last_n(t.events, ["event_type"], ["ts", "event_id"], 5).groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("recency", "event_id"))), lambda x: x["event_id"]), ",").alias("latest"))
    return n.join(last, "event_type")


@query(f"""with {TAGGED}, s as (select sender, tag, confidence from tagged join mail using (id)), m as (select sender, min(tag) liked from (select sender, tag, count(*) n, max(count(*)) over (partition by sender) top from s group by 1, 2) where n = top group by 1)
select tag, count(*) n, round(avg(confidence), 9) confidence, count(*) / sum(count(*)) over () share, round(avg(case when tag <> liked then 1.0 else 0.0 end), 9) correction_rate from s join m using (sender) group by 1""")
def tagging_stats(t):
    """Tags with their mean confidence, share, and how often the sender's usual tag corrects them."""
    rows = Mb.frame(t).withColumn("d", L.tag(L.mail())).select("sender", "d.tag", "d.confidence")
    liked = St.mode(rows, ["sender"], "tag")
    g = rows.join(liked, "sender").groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("confidence"), F.round(F.avg((F.col("tag") != F.col("mode_tag")).cast("double")), 9).alias("correction_rate"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).select("tag", "n", "confidence", (F.col("n") / F.col("total")).alias("share"), "correction_rate")


@query("select 'priority' chart, o_orderpriority as label, count(*) n from orders group by 2 union all select 'status', o_orderstatus, count(*) from orders group by 2 union all select 'segment', c_mktsegment, count(*) from customer group by 2")
def chart_counts(t):
    one = lambda df, chart, c: df.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")).select(F.lit(chart).alias("chart"), "label", "n")
    return one(t.orders, "priority", "o_orderpriority").unionAll(one(t.orders, "status", "o_orderstatus")).unionAll(one(t.customer, "segment", "c_mktsegment"))


@query("with x as (select event_type = 'view' t, value < 40 p from events), c as (select count(*) filter (where t and p) tp, count(*) filter (where p) pp, count(*) filter (where t) tt, count(*) filter (where p and not t) fp, count(*) filter (where not t) nn from x) select tp / pp as \"precision\", tp / tt recall, 2 * tp / (pp + tt) f1, fp / nn false_action_rate from c")
def none_metrics(t):
    """Precision, recall and F1 of one class, and the rate of false alarms, in one pass."""
    x = t.events.select((F.col("event_type") == "view").alias("t"), (F.col("value") < 40).alias("p"))
    c = x.agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if("p").alias("pp"), F.count_if("t").alias("tt"), F.count_if(F.col("p") & ~F.col("t")).alias("fp"), F.count_if(~F.col("t")).alias("nn"))
    return c.select((F.col("tp") / F.col("pp")).alias("precision"), (F.col("tp") / F.col("tt")).alias("recall"), (2 * F.col("tp") / (F.col("pp") + F.col("tt"))).alias("f1"), (F.col("fp") / F.col("nn")).alias("false_action_rate"))


@query("select user_id, min(ts) first_seen, max(ts) last_seen, count(*) messages, count(distinct event_type) kinds from events group by 1")
def profiles(t):
    return t.events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("messages"), F.countDistinct("event_type").alias("kinds"))


@query("select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) r from conversations) where r <= 6")
def keep_last_2n(t):
    """What a bounded state would hold: twice the context of three."""
    return St.last_n(t.conversations.select("conv_id", "turn"), ["conv_id"], ["turn"], 6).drop("recency")


@query("select 'both' op, count(*) n from (select doc_id from documents intersect select doc_id from labels) union all select 'unlabelled', count(*) from (select doc_id from documents except select doc_id from labels) union all select 'all', count(*) from (select doc_id from documents union select doc_id from labels)")
def set_operations(t):
    d, l = t.documents.select("doc_id"), t.labels.select("doc_id")
    rows = [("both", d.intersect(l)), ("unlabelled", d.exceptAll(l).distinct()), ("all", d.union(l).distinct())]
    out = None
    for name, df in rows:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id) r from documents where source in ('src4', 'src5', 'src6')) where r <= 34 order by source, doc_id limit 100")
def sequential_quota(t):
    """Sources in order, each up to the ceiling of its share, a hard stop at the total: the last may fall short."""
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = t.documents.where(F.col("source").isin("src4", "src5", "src6")).withColumn("r", F.row_number().over(w)).where("r <= 34")
    return rows.orderBy("source", "doc_id").limit(100).select("doc_id", "source")


@query("select doc_id from (select doc_id, row_number() over (partition by md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) order by doc_id) r from documents where length(text) > 0) where r = 1")
def nonempty_unique(t):
    rows = t.documents.where(F.length(X.text("text")) > 0)
    return D.first_of(rows.select("doc_id", "text"), F.md5(X.norm_basic("text")), "doc_id").select("doc_id")


# A small lexicon of moods; any other is a parameter of A.polarity.
MOODS = {"thanks": 0.52, "good": 0.72, "disappointed": -0.76, "broken": -0.4, "issue": -0.2, "please": 0.2, "critical": -0.32, "suspicious": -0.52}
WORDS = "list_filter(string_split_regex(lower(body), '[^\\w\\p{L}'']+'), lambda w: w <> '')"
EACH = "case w[i] " + " ".join(f"when '{k}' then {v}" for k, v in MOODS.items()) + " end * case when i > 1 and (w[i - 1] in ('not', 'no', 'never') or ends_with(w[i - 1], 'n''t')) then -0.5 else 1.0 end"


@query(f"""with {TAGGED}, w as (select id, {WORDS} w, row_number() over (order by id) k from mail), e as (select id, unnest(list_filter(list_transform(range(1, len(w) + 1), lambda i: {EACH}), lambda x: x is not null)) x from w),
p as (select id, cast(round(avg(x), 2) as double) polarity from e group by 1), m as ({SQL["message_metrics"].replace("with " + Mb.LOWERED, "select * from (with " + Mb.LOWERED, 1)}))
select m.id, intent, urgency, has_deadline, word_count, coalesce(polarity, 0.0) polarity, case when coalesce(polarity, 0.0) > 0.1 then 'positive' when coalesce(polarity, 0.0) < -0.1 then 'negative' else 'neutral' end sentiment, tag, round(confidence, 9) confidence from m join tagged using (id) left join p using (id)""")
def enrichment(t):
    """Each message with its metrics, polarity and sentiment, tag and confidence: one pass, nothing is joined."""
    x, d = L.mail().text, F.col("d")
    rows = Mb.frame(t).withColumn("d", L.tag(L.mail())).withColumn("polarity", A.polarity("body", MOODS))
    phrases = F.flatten(F.array(*(F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in L.DEADLINES)))
    return rows.select(
        "id", L.cascade(x, L.INTENT_CASCADE, "general").alias("intent"), L.cascade(x, L.URGENCY_CASCADE, "low").alias("urgency"), (F.size(phrases) > 0).alias("has_deadline"), F.size(X.words(x)).cast("long").alias("word_count"),
        "polarity", A.sentiment_label(F.col("polarity")).alias("sentiment"), d["tag"].alias("tag"), F.round(d["confidence"], 9).alias("confidence"),
    )


@query(f"with {TAGGED}, r as (select id, tag, row_number() over (order by score desc, id) k from tagged) select cast(k as int) k, k || '. ' || tag || ' | ' || subject line from r join mail using (id) where k <= 5")
def daily_brief(t):
    """The first lines of a brief."""
    rows = Mb.frame(t).withColumn("d", L.tag(L.mail())).orderBy(F.desc("d.score"), "id").limit(5)
    k = F.row_number().over(Window.orderBy(F.desc("d.score"), "id"))
    return rows.withColumn("k", k).select("k", F.concat("k", F.lit(". "), "d.tag", F.lit(" | "), "subject").alias("line"))


SWEEP = "c as (select least(value / 200, 1.0) p, event_type = 'purchase' y from events), th(threshold) as (values (0.30), (0.35), (0.40), (0.45), (0.50), (0.55)), g as (select cast(threshold as double) threshold, sum(case when p >= threshold and y then 1 else 0 end) tp, sum(case when p >= threshold then 1 else 0 end) pp, sum(case when y then 1 else 0 end) yy from c, th group by 1), s as (select threshold, case when tp / pp >= 0.15 then 0.4 * tp / yy + 0.6 * 2 * tp / (pp + yy) else 0.0 end score from g)"


@query(f"with {SWEEP} select threshold, round(score, 9) score from s")
def sweep_composite(t):
    """Composite of recall and F1 at each threshold, 0 below a precision bound; no model is fitted again."""
    s = M.sweep(t.events, F.least(F.col("value") / 200, F.lit(1.0)), F.col("event_type") == "purchase", [0.30, 0.35, 0.40, 0.45, 0.50, 0.55])
    return s.select("threshold", F.round(F.when(F.col("precision") >= 0.15, 0.4 * F.col("recall") + 0.6 * F.col("f1")).otherwise(0.0), 9).alias("score"))
