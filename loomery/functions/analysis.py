"""Message analysis: chat intents, language markers, actions, model output, timestamps, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import all_of, strip, text

# Request phrases, social phrases and ordered rules of the chat classifier.
REQUESTS = [
    r"\b(can|could|would) you\s+(send|share|provide|review|check|help|prepare|forward|update)\b", r"\bplease\s+\w+", r"\bsend me\b", r"\bi need\b", r"\bneed (?:you|a|the|this|that)\b",
]
SOCIAL = [r"\bhow are you\b", r"\bwhat's up\b", r"\bhow's it going\b", r"\bhang out\b", r"\bparty\b"]
QUESTION_START = r"^(what|how|when|where|why|which|who|is|are|can|could|would|do|does|did)\b"
CHAT_RULES = {
    "complaint": [r"\bnot working\b", r"\bproblem\b", r"\bissue\b", r"\berror\b", r"\bbug\b", r"\bbroken\b"],
    "appreciation": [r"\bthank(?:s| you)?\b", r"\bappreciate\b", r"\bwell done\b", r"\bgreat job\b"],
    "urgent": [r"\burgent\b", r"\basap\b", r"\bemergency\b", r"\bcritical\b", r"\bimmediately\b"],
    "social": SOCIAL,
    "informational": [r"\bfyi\b", r"\bfor your information\b", r"\bjust letting you know\b", r"\bheads up\b"],
    "confirmation": [r"\bconfirmed\b", r"\bgot it\b", r"\bunderstood\b", r"\bsounds good\b"],
    "schedule": [r"\bmeeting\b", r"\bappointment\b", r"\bschedule\b", r"\bcalendar\b"],
    "follow_up": [r"\bfollow[- ]?up\b", r"\bany update\b", r"\bany news\b", r"\bheard back\b"],
    "question": [r"\bwhat\b", r"\bhow\b", r"\bwhen\b", r"\bwhere\b", r"\bwhy\b", r"\bwhich\b", r"\bwho\b", r"\?"],
}
CHAT_URGENCY = {
    "high": (["urgent", "asap", "emergency", "critical", "immediately", "right now", "deadline today", "today", "in 2 hours", "in two hours", "within 2 hours", "within two hours"], 0.95),
    "medium": (["soon", "quickly", "priority", "important", "deadline", "by tomorrow", "this week", "tomorrow"], 0.75),
    "low": (["when you can", "no rush", "whenever", "no hurry", "take your time"], 0.9),
}
# Frequent words of four languages.
MARKERS = {
    "en": ["the", "and", "please", "with", "your"], "de": ["der", "die", "das", "und", "bitte", "mit", "ihre"],
    "fr": ["le", "la", "les", "et", "avec", "veuillez", "votre"], "es": ["el", "la", "los", "y", "por", "favor", "su"],
}
# Emoji of either sentiment.
GLAD = ["😃", "😊", "👍", "🎉", "❤️", "😍", "🔥", "✅", "💯", "🚀"]
SAD = ["😢", "😡", "👎", "😞", "😠", "💔", "😰", "😨", "❌", "⚠️"]
EMOJI = r"[\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{1F000}-\x{1FAFF}©®‼⁉™ℹ〰〽㊗㊙]"
# Action types, and the beginnings that stand for them, in order.
ACTION_TYPES = ["create_calendar_event", "review_document", "create_reminder", "contact_sender", "create_task", "follow_up", "reply"]
ACTION_STARTS = [("create_calendar_event", "calendar"), ("reply", "respond"), ("create_reminder", "reminder"), ("review_document", "review"), ("follow_up", "follow up"), ("contact_sender", "contact"), ("create_task", "task")]
NO_ACTION = ["none", "no action", "no task", "informational", "n/a"]
DAY = r"\b(today|tomorrow|monday|tuesday|wednesday|thursday|friday|saturday|sunday|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}(?:st|nd|rd|th)?|\d{1,2}/\d{1,2}(?:/\d{2,4})?)\b"
HOUR = r"\b(\d{1,2}(?::\d{2})?\s*(?:am|pm|est|pst|cst|utc|gmt)|eod|end\s+of\s+day|noon|midnight)\b"
# Patterns of facts that a summary should keep.
FACTS = [r"\$\d+(?:,\d{3})*(?:\.\d{2})?", r"\b\d+%", r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}\b", r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b"]

# Patterns of the priority signals, matched in any case.
URGENT_SUBJECT = r"\b(urgent|urgently|asap|immediately|critical|emergency|action\s+required|time[\s-]sensitive|high\s+priority|immediate\s+attention)\b"
URGENT_BODY = r"\b(urgent|urgently|asap|immediately|critical|emergency|action\s+required|time[\s-]sensitive|deadline|due\s+date|at\s+your\s+earliest|without\s+delay|needs\s+immediate)\b"
DEADLINE = r"\b(due\s+by|deadline\s+is|by\s+eod|by\s+end\s+of\s+day|by\s+tomorrow|expires\s+on|before\s+\d{1,2}(:\d{2})?\s*(am|pm)?|within\s+\d+\s+(hours?|days?|minutes?)|due\s+today)\b"
SECURITY = r"\b(compromised|unauthorized|suspicious\s+activity|security\s+alert|security\s+breach|account\s+locked|suspended\s+account|password\s+reset|verify\s+your\s+identity|2fa\s+code|access\s+denied)\b"
FINANCIAL = r"\b(payment\s+overdue|past\s+due|final\s+notice|invoice\s+overdue|immediate\s+payment|account\s+suspension\s+warning|balance\s+due|late\s+fee)\b"
IMPERATIVE = r"\b(please\s+confirm|please\s+approve|please\s+respond|action\s+needed|needs\s+approval|requires\s+your\s+attention|approval\s+required)\b"


def priority_signals(subject: Column, clean: Column) -> dict[str, Column]:
    """Eleven signals of a subject and a body without boilerplate, capped and scaled to 0-1."""
    letters = F.length(F.regexp_replace(subject, r"\P{L}", ""))
    both = F.concat(subject, F.lit("\n"), clean)
    share = lambda x, top: F.round(F.least(x, F.lit(top)) / float(top), 9)
    flag = lambda c, p: c.rlike("(?i)" + p).cast("double")
    marks = lambda m: F.length(subject) - F.length(F.replace(subject, F.lit(m), F.lit("")))
    return {
        "subject_urgent": flag(subject, URGENT_SUBJECT), "body_urgent": share(F.regexp_count(clean, F.lit("(?i)" + URGENT_BODY)), 5), "has_deadline": flag(both, DEADLINE), "has_security": flag(both, SECURITY),
        "has_financial": flag(both, FINANCIAL), "has_imperative": flag(both, IMPERATIVE), "exclamations": share(marks("!"), 3), "questions": share(marks("?"), 3),
        "caps_ratio": F.round(F.when(letters >= 5, F.length(F.regexp_replace(subject, r"\P{Lu}", "")) / letters).otherwise(0.0), 9), "subject_length": share(F.length(subject), 150), "body_length": share(F.length(clean), 2000),
    }


def some(col: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | col.rlike(p)
    return out


def chat_intent(col: Column | str) -> Column:
    """(intent, confidence): requests, then social phrases, whole questions, then the first rule with hits."""
    t = strip(F.lower(text(col)))
    made = lambda name, conf: F.struct(F.lit(name).alias("intent"), conf.cast("double").alias("confidence"))
    out = F.when(some(t, REQUESTS), made("request", F.lit(0.9))).when(some(t, SOCIAL), made("social", F.lit(0.9)))
    out = out.when(t.endswith("?") & t.rlike(QUESTION_START), made("question", F.lit(0.9)))
    for name, patterns in CHAT_RULES.items():
        n = sum((F.regexp_count(t, F.lit(p)) for p in patterns), F.lit(0))
        out = out.when(n > 0, made(name, F.least(F.lit(1.0), 0.65 + n * 0.1)))
    return out.otherwise(made("informational", F.lit(0.3)))


def chat_urgency(col: Column | str) -> Column:
    """(urgency, confidence) by phrases, else by length and questions."""
    raw = text(col)
    t = F.lower(raw)
    has = lambda words: some_word(t, words)
    made = lambda name, conf: F.struct(F.lit(name).alias("urgency"), F.lit(conf).alias("confidence"))
    out = F
    for name, (words, conf) in CHAT_URGENCY.items():
        out = out.when(has(words), made(name, conf))
    return out.when(F.length(raw) < 50, made("low", 0.4)).when(raw.contains("?") | has(["need", "want", "require"]), made("medium", 0.5)).otherwise(made("low", 0.3))


def some_word(t: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w)
    return out


def language_of(col: Column | str) -> Column:
    """(language, score): the language with the greatest share of its marker words, first on ties; short texts are unknown."""
    t = strip(F.regexp_replace(F.lower(text(col)), r"(?U)\s+", " "))
    tokens = F.array_distinct(F.split(t, r"(?U)[^\w]+"))
    scored = [F.struct((F.size(F.array_intersect(tokens, F.array(*map(F.lit, m)))) / len(m)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("language")) for i, (name, m) in enumerate(MARKERS.items())]
    best = F.greatest(*scored)
    known = (F.length(t) >= 20) & (best["score"] > 0)
    return F.struct(F.when(known, best["language"]).otherwise("unknown").alias("language"), F.when(known, best["score"]).otherwise(0.0).alias("score"))


def marker_score(col: Column | str, language: Column) -> Column:
    """Share of a language's marker words that the text has; 0 for other languages."""
    tokens = F.array_distinct(F.split(strip(F.regexp_replace(F.lower(text(col)), r"(?U)\s+", " ")), r"(?U)[^\w]+"))
    out = F.lit(0.0)
    for name, words in MARKERS.items():
        out = F.when(language == name, F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))) / len(words)).otherwise(out)
    return out


def polarity(col: Column | str, weights: dict[str, float]) -> Column:
    """Mean weight of a text's words that a lexicon has, rounded to 2 places; 0 without any.

    A negation right before a word turns its weight to minus a half of it. The lexicon is a parameter, as large as given.
    """
    words = F.filter(F.split(F.lower(text(col)), r"(?U)[^\w']+"), lambda w: w != "")
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.create_map().cast("map<string,double>")
    before = lambda ws, i: F.coalesce(F.get(ws, i - 1), F.lit(""))
    turned = lambda ws, i: F.when((i > 0) & (before(ws, i).isin("not", "no", "never") | before(ws, i).endswith("n't")), -0.5).otherwise(1.0)
    each = F.transform(F.array(words), lambda ws: F.transform(ws, lambda w, i: F.element_at(table, w).cast("double") * turned(ws, i)))  # binds the words once
    found = F.filter(F.element_at(each, 1), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.round(F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found), 2)).otherwise(0.0)


def emoji_sentiment(col: Column | str) -> Column:
    t = text(col)
    return F.when(~t.rlike(EMOJI), "none").when(some_word(t, GLAD), "positive").when(some_word(t, SAD), "negative").otherwise("neutral")


def sentiment_label(polarity: Column) -> Column:
    return F.when(polarity > 0.1, "positive").when(polarity < -0.1, "negative").otherwise("neutral")


# Words of the stand-in analysis (urgent, meeting, request, negative), and of the expected action (calendar,
# reply, intents without an action, intents with a task, tasks).
MOCK = {"urgent": ["urgent", "asap", "immediately"], "meeting": ["meeting", "calendar"], "request": ["please", "can you"], "negative": ["problem", "failed", "angry"]}
CALENDAR, REPLY, ASKED = ["meeting", "schedule"], "reply", "can you"
IDLE_INTENTS, TASK_INTENTS = ["promotion", "other", "notification"], ["request", "security", "transactional"]
TASKS = ["submit", "reset", "verify", "pay", "send", "approve"]


def mock_analysis(subject: Column | str, body: Column | str) -> Column:
    """The deterministic analysis that stands in for a model."""
    s, b = strip(text(subject)), strip(text(body))
    t = strip(F.concat(s, F.lit(" "), b))
    low = F.lower(t)
    urgent = F.when(some_word(low, MOCK["urgent"]), "high").otherwise("medium")
    intent = F.when(some_word(low, MOCK["meeting"]), "meeting").when(some_word(low, MOCK["request"]), "request").when(t.contains("?"), "question").otherwise("information")
    head = F.concat(F.substring(b, 1, 180), F.when(F.length(b) > 180, "...").otherwise(""))
    summary = F.coalesce(F.nullif(head, F.lit("")), F.nullif(s, F.lit("")), F.lit("No message content"))
    return F.struct(summary.alias("summary"), intent.alias("intent"), urgent.alias("urgency"), F.when(some_word(low, MOCK["negative"]), "negative").otherwise("neutral").alias("sentiment"), F.lit(0.5).alias("confidence"))


def expected_action(intent: Column, subject: Column, body: Column) -> Column:
    s, b = F.lower(subject), F.lower(body)
    out = F.when((intent == "meeting") | some_word(s, CALENDAR), "create_calendar_event").when((intent == "question") | s.contains(REPLY) | b.contains(ASKED), "reply")
    out = out.when(intent.isin(*IDLE_INTENTS), "none").when(intent == "follow_up", "follow_up")
    task = some_word(b, TASKS)
    return out.when(intent.isin(*TASK_INTENTS), F.when(task, "create_task").otherwise("reply")).otherwise("none")


def parsed_action(raw: Column, full: Column) -> Column:
    """(type, day, hour) of a model's text; day and hour only if the message has them. Unknown texts give no action."""
    t = strip(F.lower(text(raw)))
    kind = F
    for a in ACTION_TYPES:
        kind = kind.when(t.startswith(a) | t.contains(f"action_type: {a}") | t.contains(f"action: {a}"), a)
    kind = kind.when(some_word(t, NO_ACTION), "none")
    for a, start in ACTION_STARTS:
        kind = kind.when(t.startswith(start), a)
    kind = kind.otherwise("none")
    first = lambda p: F.when(kind != "none", F.nullif(F.regexp_extract(full, "(?i)" + p, 0), F.lit("")))
    return F.struct(kind.alias("type"), first(DAY).alias("day"), first(HOUR).alias("hour"))


def facts(col: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*(all_of(col, "(?i)" + p) for p in FACTS))))


def kept_facts(source: Column, summary: Column) -> Column:
    """Share of a text's facts that its summary has; 1 without facts."""
    all_ = facts(source)
    return F.when(F.size(all_) == 0, 1.0).otherwise(F.size(F.filter(all_, lambda x: F.lower(summary).contains(F.lower(x)))) / F.size(all_))


def model_label(payload: Column | str, intents: tuple[str, ...], priorities: tuple[str, ...]) -> Column:
    """(intent, priority, confidence, error) of a model's JSON; error is null if it is valid."""
    p = F.from_json(payload, "intent string, priority string, confidence string")
    intent, priority, conf = strip(F.lower(F.coalesce(p["intent"], F.lit("")))), strip(F.lower(F.coalesce(p["priority"], F.lit("")))), F.coalesce(p["confidence"], F.lit("0")).try_cast("double")
    error = F.when(~intent.isin(*intents), "intent").when(~priority.isin(*priorities), "priority").when(conf.isNull(), "confidence: not a number").when(~conf.between(0.0, 1.0), "confidence: range")
    return F.struct(intent.alias("intent"), priority.alias("priority"), conf.alias("confidence"), error.alias("error"))


def resolution(intent: Column, rule_intent: Column, priority: Column, rule_priority: Column) -> Column:
    """Why a model's label stands where rules disagree; null rule priorities don't count."""
    a = F.when(rule_intent != intent, F.concat(F.lit("intent "), intent, F.lit(" over "), rule_intent))
    b = F.when(rule_priority.isNotNull() & (rule_priority != priority), F.concat(F.lit("priority "), priority, F.lit(" over "), rule_priority))
    return F.when(a.isNull() & b.isNull(), "agreement").otherwise(F.concat_ws("; ", a, b))


def iso_time(col: Column | str, otherwise: Column) -> Column:
    """A timestamp with Z, an offset or none (UTC); what can't be parsed is `otherwise`."""
    return F.coalesce(F.try_to_timestamp(F.col(col) if isinstance(col, str) else col), otherwise)


def mail_time(col: Column) -> Column:
    """An RFC 2822 date, with or without weekday and zone, or an ISO date."""
    plain = F.regexp_replace(F.regexp_replace(strip(col), r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", "")
    zoned = F.regexp_replace(plain, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    tries = [(zoned, "d MMM yyyy HH:mm:ss Z"), (plain, "d MMM yyyy HH:mm:ss"), (plain, "yyyy-MM-dd HH:mm:ss"), (plain, "yyyy-MM-dd'T'HH:mm:ss")]
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for c, f in tries))


def prompt(task: str, subject: Column, body: Column, intent: Column, priority: Column, end: str, most: int = 1500) -> Column:
    """The task, the known labels, the bounded message and the place for the answer."""
    labels = F.concat_ws(", ", F.concat(F.lit("Category: "), intent), F.concat(F.lit("Priority: "), priority))
    cut = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("... [truncated]"))).otherwise(body)
    mail = F.concat(F.when(strip(subject) != "", F.concat(F.lit("Subject: "), strip(subject), F.lit("\n"))).otherwise(""), F.lit("Body: "), cut)
    return F.concat(F.lit(task + "\n\n"), F.when(labels != "", F.concat(F.lit("["), labels, F.lit("]\n"))).otherwise(""), mail, F.lit("\n\n" + end))


def corrected_confidence(old: Column, changed: Column, quality: Column) -> Column:
    """Confidence after one feedback: reduced to 0.1 at least if the tag changed, raised to 1 at most if not."""
    down = F.greatest(F.lit(0.1), old * F.when(quality < 0, 0.6).otherwise(0.7))
    return F.when(changed, down).otherwise(F.least(F.lit(1.0), old * F.when(quality > 0, 1.2).otherwise(1.1)))
