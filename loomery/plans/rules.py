"""Rule scoring over the fixed mailbox: taggers, intents, cascades, entities, priorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import analysis as A
from ..functions import lexicon as L
from ..functions import text as X
from . import mailbox as M
from .registry import lit, query


def hits(col: str, words) -> str:
    return "(" + " + ".join(f"cast(contains({col}, {lit(w)}) as int)" for w in words) + ")"


def found(col: str, patterns) -> str:
    return "(" + " + ".join(f"cast(regexp_matches({col}, {lit(p)}) as int)" for p in patterns) + ")"


def case(pairs, otherwise: str) -> str:
    return "case " + " ".join(f"when {test} then {value}" for test, value in pairs) + f" else {otherwise} end"


def argmax(scores: dict[str, str]) -> str:
    """The first declared name with the greatest score."""
    top = "greatest(" + ", ".join(scores) + ")"
    return case([(f"{k} = {top}", lit(k)) for k in list(scores)[:-1]], lit(list(scores)[-1]))


TIME = "least(5.0, " + " + ".join(f"cast(contains(t, {lit(w)}) as int) * {p}" for w, p in L.TIME_WORDS.items()) + f" + {found('t', L.TIME_PATTERNS)} * 1.5)"
DOMAIN = "case when contains(f, '@') then split_part(f, '@', 2) else '' end"


def tag_sql(tag: str) -> str:
    p = L.TAGS[tag]
    sender = "(" + " + ".join(f"cast(contains(f, {lit(w)}) or contains({DOMAIN}, {lit(w)}) as int)" for w in p["sender"]) + ")"
    score = f"({hits('t', p['keywords'])} / {len(p['keywords'])} * 2.0 + {found('s', p['subject'])} / {len(p['subject'])} * 1.5 + {sender} / {len(p['sender'])}) * {p['weight']}"
    return f"cast({score}{' + ' + TIME if tag == 'URGENT' else ''} as double)"


SCORES = M.LOWERED + ", scored as (select id, s, b, f, t, " + ", ".join(f"{tag_sql(t)} {t}" for t in L.TAGS) + " from low)"
TOP = "greatest(" + ", ".join(L.TAGS) + ")"
TAGGED = SCORES + f", tagged as (select *, {case([(f'{TOP} > 0.5', argmax(dict.fromkeys(L.TAGS)))], lit('GENERAL'))} tag, {TOP} score, case when {TOP} > 0.5 then least({TOP} / 10, 1.0) else 0.3 end confidence from scored)"
INTENT = {k: f"({found('s', p['subject'])} * 2.0 + {hits('t', p['keywords'])}) * {p['weight']}" for k, p in L.INTENTS.items()}
INTENTS = ", intents as (select id, " + ", ".join(f"cast({v} as double) {k}" for k, v in INTENT.items()) + " from low)"
ITOP = "greatest(" + ", ".join(INTENT) + ")"


def rounded(cols) -> str:
    return ", ".join(f"round({c}, 9) {c}" for c in cols)


def box(t):
    return M.frame(t)


@query(f"with {SCORES} select id, {rounded(L.TAGS)} from scored")
def tag_scores(t):
    s = L.tag_scores(L.mail())
    return box(t).select("id", *(F.round(v.cast("double"), 9).alias(k) for k, v in s.items()))


@query(f"with {TAGGED} select id, tag, round(score, 9) score, round(confidence, 9) confidence from tagged")
def tag_decision(t):
    return box(t).withColumn("d", L.tag(L.mail())).select("id", "d.tag", F.round("d.score", 9).alias("score"), F.round("d.confidence", 9).alias("confidence"))


@query(f"with {TAGGED}, pref(f, liked) as (values ('bob@corp.example', 'MEETING'), ('news@blog.example', 'SECURITY')), p as (select scored.*, liked from scored left join pref using (f)) select id, liked, " + ", ".join(f"round({k} * case when liked is null then 1.0 when liked = '{k}' then 1.2 else 0.8 end, 9) {k}" for k in L.TAGS) + " from p")
def tag_preference(t):
    """Scores after the sender's last preference: a left join that is broadcast by its size."""
    pref = t.spark.createDataFrame([("bob@corp.example", "MEETING"), ("news@blog.example", "SECURITY")], "f string, liked string")
    rows = box(t).withColumn("f", F.lower("sender")).join(pref, "f", "left")
    return rows.select("id", "liked", *(F.round(v.cast("double"), 9).alias(k) for k, v in L.tag_scores(L.mail(), F.col("liked")).items()))


@query(f"with {M.LOWERED}{INTENTS} select id, case when {ITOP} >= 2.0 then {argmax(INTENT)} else 'other' end intent, {ITOP} score, case when {ITOP} >= 2.0 then least(0.5 + {ITOP} / 20, 1.0) else 0.5 end strength from intents")
def intent_rules(t):
    """Winner at a score of 2 or more; strength is a bounded form of the score."""
    best = L.winner(L.intent_scores(L.mail()))
    rows = box(t).withColumn("w", best)
    sure = F.col("w.score") >= 2.0
    return rows.select("id", F.when(sure, F.col("w.name")).otherwise("other").alias("intent"), F.col("w.score").alias("score"), F.when(sure, F.least(0.5 + F.col("w.score") / 20, F.lit(1.0))).otherwise(0.5).alias("strength"))


@query(f"""with {TAGGED}{INTENTS}, best as (select id, {ITOP} top, case when {ITOP} >= 2.0 then {argmax(INTENT)} else 'other' end intent from intents), w as (select id, intent, case when tag in ('URGENT', 'FINANCIAL', 'SECURITY') then 'high' when tag in ('MEETING', 'IMPORTANT') then 'medium' else 'low' end priority, round(score + top, 3) rule_score from tagged join best using (id))
select *, case when rule_score >= 3 then 'high_score' when rule_score >= 1 then 'ambiguous' else 'low_signal' end population from w""")
def weak_label(t):
    """Dual weak labels: priority from the tag, intent from the rules, and the population by summed score."""
    rows = box(t).withColumns({"d": L.tag(L.mail()), "w": L.winner(L.intent_scores(L.mail()))})
    priority = F.when(F.col("d.tag").isin(*L.HIGH_TAGS), "high").when(F.col("d.tag").isin(*L.MEDIUM_TAGS), "medium").otherwise("low")
    score = F.round(F.col("d.score") + F.col("w.score"), 3)
    out = rows.select("id", F.when(F.col("w.score") >= 2.0, F.col("w.name")).otherwise("other").alias("intent"), priority.alias("priority"), score.alias("rule_score"))
    return out.withColumn("population", F.when(F.col("rule_score") >= 3, "high_score").when(F.col("rule_score") >= 1, "ambiguous").otherwise("low_signal"))


@query(f"with {M.LOWERED}, c as (select id, t, " + ", ".join(f"{hits('t', w)} {k}" for k, w in L.CATEGORIES.items()) + f" from low), b as (select *, greatest({', '.join(L.CATEGORIES)}) top from c) select id, case when top > 0 then {argmax(dict.fromkeys(L.CATEGORIES))} else 'general' end category, case when top > 0 then round(top / case " + " ".join(f"when {argmax(dict.fromkeys(L.CATEGORIES))} = '{k}' then {len(w)}" for k, w in L.CATEGORIES.items()) + " end, 9) else 0.0 end confidence from b")
def category_argmax(t):
    m = L.mail()
    rows = box(t).withColumn("w", L.winner({k: L.hits(m.text, w) for k, w in L.CATEGORIES.items()}))
    share = F.col("w.score") / L.points(F.col("w.name"), {k: float(len(w)) for k, w in L.CATEGORIES.items()}, 1.0)
    some = F.col("w.score") > 0
    return rows.select("id", F.when(some, F.col("w.name")).otherwise("general").alias("category"), F.when(some, F.round(share, 9)).otherwise(0.0).alias("confidence"))


CASCADE = {k: hits("t", w) + " > 0" for k, w in L.INTENT_CASCADE.items()}
URGENCY = {k: hits("t", w) + " > 0" for k, w in L.URGENCY_CASCADE.items()}
DEADLINE = "list_concat(" + ", ".join(f"regexp_extract_all(t, {lit(p)})" for p in L.DEADLINES[:1]) + ", [])"
for p in L.DEADLINES[1:]:
    DEADLINE = f"list_concat({DEADLINE}, regexp_extract_all(t, {lit(p)}))"


@query(f"with {M.LOWERED} select id, {case([(v, lit(k)) for k, v in CASCADE.items()], lit('general'))} intent, {case([(v, lit(k)) for k, v in URGENCY.items()], lit('low'))} urgency, len({DEADLINE}) > 0 has_deadline, array_to_string({DEADLINE}, '|') deadlines, len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) word_count, length(t) char_count from low")
def message_metrics(t):
    x = L.mail().text
    phrases = F.flatten(F.array(*(F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in L.DEADLINES)))
    return box(t).select("id", L.cascade(x, L.INTENT_CASCADE, "general").alias("intent"), L.cascade(x, L.URGENCY_CASCADE, "low").alias("urgency"), (F.size(phrases) > 0).alias("has_deadline"), F.array_join(phrases, "|").alias("deadlines"), F.size(X.words(x)).cast("long").alias("word_count"), F.length(x).cast("long").alias("char_count"))


SHORT = {k: f"{hits('t', w)} * {p}" for k, (w, p) in L.SHORT_TAGS.items()}
SHORT["IMPORTANT"] = f"case when {hits('f', ['ceo', 'manager', 'director', 'admin'])} > 0 then 0.3 else 0.0 end"
SHORT["NEWSLETTER"] = f"cast({hits('t', L.NEWSLETTER_WORDS)} > 0 as int) * 0.2 + case when {hits('f', ['ceo', 'manager', 'director', 'admin'])} = 0 and {hits('f', ['noreply', 'no-reply', 'automated'])} > 0 then 0.2 else 0.0 end"
SHORT["GENERAL"] = "0.1"
SHORT = {k: f"cast({SHORT[k]} as double)" for k in L.SHORT_ORDER}


@query(f"with {M.LOWERED}, k as (select id, " + ", ".join(f"round({v}, 6) {k}" for k, v in SHORT.items()) + f" from low) select id, {argmax(SHORT)} tag, least(greatest({', '.join(SHORT)}), 1.0) confidence from k")
def short_tagger(t):
    s = {k: F.round(v.cast("double"), 6) for k, v in L.short_tag_scores(L.mail()).items()}
    return box(t).withColumn("w", L.winner(s)).select("id", F.col("w.name").alias("tag"), F.least("w.score", F.lit(1.0)).alias("confidence"))


@query(f"""with {TAGGED}, m as (select id, {case([(v, lit(k)) for k, v in CASCADE.items()], lit('general'))} intent, {case([(v, lit(k)) for k, v in URGENCY.items()], lit('low'))} urgency, len({DEADLINE}) > 0 has_deadline from low),
q(state, v) as (values ('has_deadline_intent_task_medium_confidence_neutral_sentiment_tag_MEETING_urgency_medium', 0.5)),
st as (select tagged.id, tag, confidence, intent, urgency, has_deadline, array_to_string(list_sort(list_filter(['tag_' || tag, case when confidence > 0.7 then 'high_confidence' when confidence > 0.4 then 'medium_confidence' else 'low_confidence' end, 'neutral_sentiment', 'urgency_' || urgency, 'intent_' || intent, case when has_deadline then 'has_deadline' end], lambda x: x is not null)), '_') state from tagged join m using (id)),
b as (select id, state, greatest(0.1, {case([(f"tag = '{k}'", str(v)) for k, v in L.TAG_POINTS.items()], '3.0')} + confidence * 2.0 + {case([(f"urgency = '{k}'", str(v)) for k, v in L.URGENCY_POINTS.items()], '0.0')} + cast(has_deadline as int) * 2.0 + {case([(f"intent = '{k}'", str(v)) for k, v in L.INTENT_POINTS.items()], '0.0')}) base from st)
select id, b.state, round(base, 9) base, cast(coalesce(v, 0.0) as double) q, round(base + coalesce(v, 0.0), 9) score from b left join q using (state)""")
def priority_scores(t):
    """Base points and learned value of the state key, by a left join."""
    x = L.mail().text
    rows = box(t).withColumns({"d": L.tag(L.mail()), "intent": L.cascade(x, L.INTENT_CASCADE, "general"), "urgency": L.cascade(x, L.URGENCY_CASCADE, "low")})
    late = F.size(F.flatten(F.array(*(F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in L.DEADLINES)))) > 0
    conf = F.col("d.confidence")
    tier = F.when(conf > 0.7, "high_confidence").when(conf > 0.4, "medium_confidence").otherwise("low_confidence")
    keys = F.array(F.concat(F.lit("tag_"), F.col("d.tag")), tier, F.lit("neutral_sentiment"), F.concat(F.lit("urgency_"), F.col("urgency")), F.concat(F.lit("intent_"), F.col("intent")), F.when(late, "has_deadline"))
    rows = rows.withColumns({"state": F.array_join(F.array_sort(F.array_compact(keys)), "_"), "base": L.base_priority(F.col("d.tag"), conf, F.col("urgency"), late, F.col("intent"))})
    q = t.spark.createDataFrame([("has_deadline_intent_task_medium_confidence_neutral_sentiment_tag_MEETING_urgency_medium", 0.5)], "state string, v double")
    out = rows.join(q, "state", "left")
    return out.select("id", "state", F.round("base", 9).alias("base"), F.coalesce("v", F.lit(0.0)).alias("q"), F.round(F.col("base") + F.coalesce("v", F.lit(0.0)), 9).alias("score"))


@query(f"with {M.SQL}, x as (select id, subject || ' ' || body t from mail) select id, array_to_string(regexp_extract_all(t, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b'), '|') emails, array_to_string(regexp_extract_all(t, '\\b\\d{{3}}[-.]?\\d{{3}}[-.]?\\d{{4}}\\b'), '|') phones, array_to_string(regexp_extract_all(t, '\\$\\d+(?:,\\d{{3}})*(?:\\.\\d{{2}})?'), '|') money, array_to_string(list_concat(list_concat(regexp_extract_all(t, '\\b\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}\\b'), regexp_extract_all(t, '\\b\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}\\b')), regexp_extract_all(t, '\\b\\w+ \\d{{1,2}}, \\d{{4}}\\b')), '|') dates, len(regexp_extract_all(t, 'https?://')) n_urls from x")
def entity_extract(t):
    e = X.entities(F.concat("subject", F.lit(" "), "body"))
    rows = box(t).withColumn("e", e)
    joined = [F.array_join(f"e.{c}", "|").alias(c) for c in ("emails", "phones", "money", "dates")]
    return rows.select("id", *joined, F.size("e.urls").cast("long").alias("n_urls"))


BOILER = "body"
for p in X.FORWARDED:
    BOILER = f"regexp_replace({BOILER}, {lit('(?is)' + p)}, '', 'g')"
BOILER = f"array_to_string(list_filter(string_split({BOILER}, chr(10)), lambda x: not starts_with(trim(x), '>')), chr(10))"
for p in (*X.DISCLAIMERS, X.SIGN_OFF):
    BOILER = f"regexp_replace({BOILER}, {lit('(?is)' + p)}, '', 'g')"


@query(f"with {M.SQL} select id, trim(regexp_replace(lower({BOILER}), '\\s+', ' ', 'g')) clean, md5(trim(regexp_replace(lower({BOILER}), '\\s+', ' ', 'g'))) hash from mail")
def boilerplate_strip(t):
    clean = X.strip_boilerplate("body")
    return box(t).select("id", clean.alias("clean"), F.md5(clean).alias("hash"))


@query(f"with {M.SQL} select id, case when regexp_extract(sender, '<([^>]+)>', 1) <> '' then regexp_extract(sender, '<([^>]+)>', 1) else sender end address, case when contains(sender, '@') then split_part(lower(sender), '@', 2) else '' end domain from mail")
def sender_address(t):
    return box(t).select("id", X.address("sender").alias("address"), F.when(F.col("sender").contains("@"), F.split_part(F.lower("sender"), F.lit("@"), F.lit(2))).otherwise("").alias("domain"))


CLEAN = f"trim(regexp_replace(lower({BOILER}), '\\s+', ' ', 'g'))"
FLAGS = ", ".join(f"cast(regexp_matches({c}, {lit('(?i)' + p)}) as double) {n}" for n, c, p in (("subject_urgent", "subject", A.URGENT_SUBJECT), ("has_deadline", "subject || chr(10) || c", A.DEADLINE), ("has_security", "subject || chr(10) || c", A.SECURITY), ("has_financial", "subject || chr(10) || c", A.FINANCIAL), ("has_imperative", "subject || chr(10) || c", A.IMPERATIVE)))


@query(f"with {M.SQL}, x as (select *, {CLEAN} c from mail) select id, {FLAGS}, round(least(len(regexp_extract_all(c, {lit('(?i)' + A.URGENT_BODY)})), 5) / 5.0, 9) body_urgent, round(least(length(subject) - length(replace(subject, '!', '')), 3) / 3.0, 9) exclamations, round(least(length(subject) - length(replace(subject, '?', '')), 3) / 3.0, 9) questions, round(case when length(regexp_replace(subject, '[^A-Za-z]', '', 'g')) >= 5 then length(regexp_replace(subject, '[^A-Z]', '', 'g')) / length(regexp_replace(subject, '[^A-Za-z]', '', 'g')) else 0.0 end, 9) caps_ratio, round(least(length(subject), 150) / 150.0, 9) subject_length, round(least(length(c), 2000) / 2000.0, 9) body_length from x")
def priority_features(t):
    """Signals of the subject and the body without boilerplate alone, capped and scaled to 0-1."""
    signals = A.priority_signals(F.col("subject"), X.strip_boilerplate("body"))
    return box(t).select("id", *(c.alias(n) for n, c in signals.items()))


@query(f"with {TAGGED} select tag, count(*) n, round(avg(score), 9) mean_score, cast(count(*) filter (where confidence > 0.7) as bigint) high, cast(count(*) filter (where confidence > 0.4 and confidence <= 0.7) as bigint) medium from tagged group by 1")
def inbox_tiles(t):
    rows = box(t).withColumn("d", L.tag(L.mail()))
    c = F.col("d.confidence")
    return rows.groupBy("d.tag").agg(F.count("*").alias("n"), F.round(F.avg("d.score"), 9).alias("mean_score"), F.count_if(c > 0.7).alias("high"), F.count_if((c > 0.4) & (c <= 0.7)).alias("medium"))


@query(f"with {TAGGED}, r as (select id, tag, row_number() over (order by score desc, id) k from tagged) select id, tag, case when k <= 3 then 'HIGH' when k <= 7 then 'MEDIUM' else 'LOW' end band from r")
def rank_bands(t):
    from ..operators.state import rank_bands as bands

    rows = box(t).withColumn("d", L.tag(L.mail())).select("id", "d.tag", F.col("d.score").alias("score"))
    return bands(rows, "id", [F.desc("score"), F.asc("id")], [("HIGH", 3), ("MEDIUM", 4)], "LOW").select("id", "tag", "band")


# Actions suggested for tags, in order.
ACTIONS = {
    "URGENT": ["quick_reply", "set_reminder", "escalate"], "MEETING": ["add_calendar", "accept_invite", "request_reschedule"], "FINANCIAL": ["review_invoice", "approve_payment", "forward_accounting"], "PROMOTIONAL": ["archive", "unsubscribe", "save_deal"],
    "SECURITY": ["verify_sender", "report_phishing", "contact_it"], "IMPORTANT": ["detailed_reply", "schedule_followup", "delegate"], "NEWSLETTER": ["read_later", "unsubscribe", "archive"], "GENERAL": ["quick_reply", "read_later", "archive"],
}


@query(f"with {TAGGED}, a(tag, pos, action) as (values " + ", ".join(f"('{k}', {i}, '{a}')" for k, v in ACTIONS.items() for i, a in enumerate(v)) + ") select id, tag, pos, action from tagged join a using (tag)")
def tag_suggestions(t):
    """Templates joined by tag; the template table is small and broadcast by its size."""
    rows = [(k, i, a) for k, v in ACTIONS.items() for i, a in enumerate(v)]
    return box(t).select("id", L.tag(L.mail())["tag"].alias("tag")).join(t.spark.createDataFrame(rows, "tag string, pos int, action string"), "tag").select("id", "tag", "pos", "action")


@query(f"with {TAGGED} select id, tag from tagged where upper(tag) = upper('urgent') or 'urgent' = 'ALL'")
def tag_filter(t, wanted: str = "urgent"):
    rows = box(t).select("id", L.tag(L.mail())["tag"].alias("tag"))
    return rows if wanted.upper() == "ALL" else rows.where(F.upper("tag") == wanted.upper())


# Words of the older priority score.
PRESSING, NOTABLE = ["urgent", "asap", "immediately", "critical"], ["deadline", "meeting", "please"]


@query(f"with {M.LOWERED} select id, cast(least(1.0, 0.25 + case when {hits('t', PRESSING)} > 0 then 0.55 when {hits('t', NOTABLE)} > 0 then 0.25 else 0.0 end) as double) priority from low")
def legacy_priority(t):
    x = L.mail().text
    more = F.when(L.any_of(x, PRESSING), 0.55).when(L.any_of(x, NOTABLE), 0.25).otherwise(0.0)
    return box(t).select("id", F.least(F.lit(1.0), 0.25 + more).alias("priority"))
