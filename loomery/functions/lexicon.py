"""Weighted rule scoring: lexicons as data, scores as column expressions, winners with declared tie order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tagger's lexicon, in declared order.
TAGS = {
    "URGENT": dict(keywords=["urgent", "asap", "immediately", "emergency", "critical", "deadline today", "overdue"], subject=["urgent:?", "asap:?", "emergency:?", "critical:?"], sender=["boss", "manager", "ceo", "director", "emergency"], weight=5.0),
    "MEETING": dict(keywords=["meeting", "appointment", "schedule", "calendar", "conference call", "zoom", "teams"], subject=["meeting", "appointment", "schedule", "call", "conference"], sender=["calendar", "scheduler", "meeting"], weight=4.0),
    "FINANCIAL": dict(keywords=["invoice", "payment", "bill", "receipt", "transaction", "refund", "purchase", "order"], subject=["invoice", "payment", "bill", "receipt", r"order #\d+"], sender=["billing", "payments", "finance", "accounting", "paypal", "stripe"], weight=4.5),
    "IMPORTANT": dict(keywords=["important", "priority", "attention required", "action needed", "follow up"], subject=["important:?", "priority:?", "action required"], sender=["hr", "admin", "support"], weight=4.0),
    "PROMOTIONAL": dict(keywords=["sale", "offer", "discount", "deal", "promotion", "coupon", "limited time"], subject=[r"\d+% off", "sale", "deal", "offer", "discount"], sender=["marketing", "promo", "deals", "offers", "newsletter"], weight=1.0),
    "NEWSLETTER": dict(keywords=["newsletter", "weekly update", "monthly digest", "blog", "news"], subject=["newsletter", "weekly", "monthly", "digest"], sender=["newsletter", "news", "blog", "updates"], weight=2.0),
    "SECURITY": dict(keywords=["security", "password", "login", "suspicious", "verify", "authentication"], subject=["security", "password", "verify", "suspicious"], sender=["security", "noreply", "alerts"], weight=4.5),
}
# The intent rules, in declared order.
INTENTS = {
    "security": dict(keywords=["password reset", "2fa", "verification code", "suspicious login", "security alert", "authentication", "unauthorized"], subject=["security alert", "password reset", "verify your account", "unusual activity"], weight=5.0),
    "transactional": dict(keywords=["order confirmation", "receipt", "invoice", "payment received", "tracking number", "shipped", "package delivered", "billing"], subject=[r"order #?\d+", "receipt for", "your order", "payment confirmation", "shipping update"], weight=4.5),
    "meeting": dict(keywords=["meeting", "calendar invite", "reschedule", "zoom link", "teams call", "appointment", "schedule a call", "sync"], subject=["meeting", "call:", "calendar", "invitation:", "reschedule"], weight=4.0),
    "request": dict(keywords=["please review", "could you send", "can you provide", "action required", "need your input", "please confirm", "kindly send"], subject=["action required", "request for", "please review", "kindly"], weight=3.5),
    "question": dict(keywords=["what is", "how do I", "could you clarify", "when will", "where can", "do you know", "is it possible to"], subject=[r"\?", "question regarding", "inquiry about", "how to"], weight=3.5),
    "promotion": dict(keywords=["discount", "special offer", "limited time", "% off", "sale ends", "coupon", "promo code", "subscribe now"], subject=[r"\d+% off", "sale", "special offer", "exclusive deal"], weight=3.0),
    "notification": dict(keywords=["system update", "scheduled maintenance", "policy update", "digest", "newsletter", "terms of service"], subject=["notification:", "update:", "maintenance", "digest"], weight=2.5),
    "complaint": dict(keywords=["issue with", "unacceptable", "disappointed", "broken", "terrible service", "demand refund", "not working"], subject=["complaint", "issue with", "disappointed", "urgent problem"], weight=3.5),
    "follow_up": dict(keywords=["following up on", "checking in on", "reminder:", "any updates on", "previous email", "status update on"], subject=["following up", "follow up", "checking in", "reminder:"], weight=3.5),
    "information": dict(keywords=["fyi", "for your information", "here is the report", "attachment included", "summary of", "notes from"], subject=["fyi:?", "report:", "summary:", "notes:"], weight=2.0),
}
# Keyword categories, in declared order.
CATEGORIES = {
    "work": ["meeting", "project", "deadline", "task", "report", "presentation", "client", "colleague", "manager", "team", "office", "business"],
    "personal": ["family", "friend", "birthday", "vacation", "weekend", "dinner", "party", "wedding", "holiday", "personal"],
    "financial": ["invoice", "payment", "bill", "receipt", "transaction", "bank", "credit", "debit", "purchase", "order", "refund", "money"],
    "promotional": ["sale", "offer", "discount", "deal", "promotion", "coupon", "limited time", "special offer", "save", "free", "buy now"],
    "newsletter": ["newsletter", "weekly", "monthly", "digest", "update", "news", "blog", "article", "subscribe", "unsubscribe"],
    "security": ["security", "password", "login", "verify", "authentication", "suspicious", "alert", "breach", "unauthorized", "account"],
    "urgent": ["urgent", "asap", "immediately", "emergency", "critical", "important", "priority", "deadline today", "now"],
}
# The intent cascade (the first group with a hit) and the urgency cascade.
INTENT_CASCADE = {
    "task": ["please do", "complete", "submit", "send", "provide", "deliver", "finish", "prepare", "review", "approve", "sign", "fill out", "update", "create", "make"],
    "request": ["can you", "could you", "would you", "will you", "please", "request", "need", "require", "ask", "?", "how to", "what is", "when", "where", "why"],
    "update": ["update", "news", "announcement", "information", "fyi", "heads up", "notice", "alert", "status", "progress"],
    "reminder": ["reminder", "don't forget", "remember", "upcoming", "scheduled", "due", "deadline", "meeting"],
    "invitation": ["invited", "invitation", "join", "attend", "event", "meeting", "webinar", "conference", "party"],
    "confirmation": ["confirm", "confirmation", "verified", "received", "acknowledged", "approved", "accepted"],
    "complaint": ["problem", "issue", "error", "wrong", "mistake", "complaint", "dissatisfied", "unhappy", "bug"],
}
URGENCY_CASCADE = {
    "high": ["urgent", "asap", "immediately", "emergency", "critical", "important", "priority", "rush", "deadline", "today"],
    "medium": ["soon", "tomorrow", "this week", "please", "need", "required", "meeting", "deadline"],
}
# Deadline phrases, in order.
DEADLINES = [r"by [\w\s]{1,20}", r"before [\w\s]{1,20}", r"due [\w\s]{1,20}", r"deadline [\w\s]{1,20}", r"until [\w\s]{1,20}", r"by end of [\w\s]{1,20}", r"no later than [\w\s]{1,20}", "asap", "immediately", "urgent", "today", "tomorrow", "this week", "next week", "eod", "cob"]
# Time words and patterns, points for each, cap 5.
TIME_WORDS = {"today": 2.0, "now": 2.0, "asap": 2.0, "immediately": 2.0, "urgent": 2.0, "tomorrow": 1.0, "this week": 1.0, "soon": 1.0, "deadline": 1.0}
TIME_PATTERNS = [r"by \d+:\d+", r"in \d+ (hour|minute|day)s?", r"before \d+", "end of (day|week|month)"]
# Weak priorities of tags and base points of tags, urgencies and intents.
HIGH_TAGS, MEDIUM_TAGS = ("URGENT", "FINANCIAL", "SECURITY"), ("MEETING", "IMPORTANT")
TAG_POINTS = {"URGENT": 10.0, "SECURITY": 9.0, "MEETING": 8.0, "FINANCIAL": 7.0, "IMPORTANT": 6.0, "GENERAL": 3.0, "PROMOTIONAL": 2.0, "NEWSLETTER": 1.0}
URGENCY_POINTS = {"high": 3.0, "medium": 1.5, "low": 0.0}
INTENT_POINTS = {"request": 2.0, "question": 1.5, "complaint": 2.5, "urgent": 3.0, "meeting": 2.0}
# The short tagger: keywords and points for each hit.
SHORT_TAGS = {
    "URGENT": (["urgent", "asap", "immediately", "emergency", "critical", "deadline"], 0.3),
    "MEETING": (["meeting", "schedule", "appointment", "conference", "call", "zoom"], 0.2),
    "FINANCIAL": (["invoice", "payment", "bill", "transaction", "account", "financial"], 0.25),
    "PROMOTIONAL": (["offer", "sale", "discount", "deal", "promotion", "limited time"], 0.15),
    "SECURITY": (["security", "password", "alert", "suspicious", "breach", "verify"], 0.3),
}
NEWSLETTER_WORDS = ["newsletter", "weekly", "monthly", "updates", "news", "unsubscribe"]
SHORT_ORDER = ["URGENT", "MEETING", "FINANCIAL", "IMPORTANT", "PROMOTIONAL", "NEWSLETTER", "SECURITY", "GENERAL"]


@dataclass(frozen=True)
class Mail:
    """The three lowered texts that rules look at."""

    subject: Column
    body: Column
    sender: Column

    @property
    def text(self) -> Column:
        return F.concat(self.subject, F.lit(" "), self.body)


def mail(subject: str = "subject", body: str = "body", sender: str = "sender") -> Mail:
    return Mail(*(F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (subject, body, sender)))


def hits(text: Column, keywords: list[str]) -> Column:
    """Keywords that occur anywhere in the text, also inside words."""
    return sum((text.contains(k).cast("int") for k in keywords), F.lit(0))


def matches(text: Column, patterns: list[str]) -> Column:
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def any_of(text: Column, keywords: list[str]) -> Column:
    return hits(text, keywords) > 0


def cascade(text: Column, groups: dict[str, list[str]], otherwise: str) -> Column:
    """The first group with a keyword in the text."""
    out = F
    for name, keywords in groups.items():
        out = out.when(any_of(text, keywords), name)
    return out.otherwise(otherwise)


def winner(scores: dict[str, Column]) -> Column:
    """(score, name) of the highest score, ties to the one declared first."""
    rows = [F.struct(s.cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores.items())]
    return F.greatest(*rows)


def time_urgency(text: Column) -> Column:
    points = sum((text.contains(w).cast("int") * p for w, p in TIME_WORDS.items()), F.lit(0.0))
    return F.least(points + matches(text, TIME_PATTERNS) * 1.5, F.lit(5.0))


def tag_scores(m: Mail, preferred: Column | None = None) -> dict[str, Column]:
    """Shares of keywords (2), subject patterns (1.5) and sender words (1) found, times the tag's weight."""
    out = {}
    for tag, p in TAGS.items():
        domain = F.when(m.sender.contains("@"), F.split_part(m.sender, F.lit("@"), F.lit(2))).otherwise("")
        sender = sum(((m.sender.contains(s) | domain.contains(s)).cast("int") for s in p["sender"]), F.lit(0))
        score = (hits(m.text, p["keywords"]) / len(p["keywords"]) * 2.0 + matches(m.subject, p["subject"]) / len(p["subject"]) * 1.5 + sender / len(p["sender"])) * p["weight"]
        if tag == "URGENT":
            score = score + time_urgency(m.text)
        if preferred is not None:
            score = score * F.when(preferred.isNull(), 1.0).when(preferred == tag, 1.2).otherwise(0.8)
        out[tag] = score
    return out


def tag(m: Mail, preferred: Column | None = None) -> Column:
    """(tag, confidence, score): GENERAL at 0.3 unless a score passes 0.5."""
    best = winner(tag_scores(m, preferred))
    return F.when(best["score"] > 0.5, F.struct(best["name"].alias("tag"), F.least(best["score"] / 10, F.lit(1.0)).alias("confidence"), best["score"].alias("score"))).otherwise(
        F.struct(F.lit("GENERAL").alias("tag"), F.lit(0.3).alias("confidence"), best["score"].alias("score")))


def intent_scores(m: Mail) -> dict[str, Column]:
    return {k: (matches(m.subject, p["subject"]) * 2.0 + hits(m.text, p["keywords"])) * p["weight"] for k, p in INTENTS.items()}


def short_tag_scores(m: Mail, preferred: Column | None = None) -> dict[str, Column]:
    found = {t: hits(m.text, words) * points for t, (words, points) in SHORT_TAGS.items()}
    important = any_of(m.sender, ["ceo", "manager", "director", "admin"])
    found["IMPORTANT"] = F.when(important, 0.3).otherwise(0.0)
    automated = ~important & any_of(m.sender, ["noreply", "no-reply", "automated"])
    found["NEWSLETTER"] = any_of(m.text, NEWSLETTER_WORDS).cast("int") * 0.2 + automated.cast("int") * 0.2
    found["GENERAL"] = F.lit(0.1)
    liked = lambda t: 0.0 if preferred is None else F.when(preferred == t, 0.4).otherwise(0.0)
    return {t: found[t] + liked(t) for t in SHORT_ORDER}


def points(key: Column, table: dict[str, float], otherwise: float) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(otherwise)


def base_priority(tag: Column, confidence: Column, urgency: Column, has_deadline: Column, intent: Column) -> Column:
    score = points(tag, TAG_POINTS, 3.0) + confidence * 2.0 + points(urgency, URGENCY_POINTS, 0.0) + has_deadline.cast("int") * 2.0 + points(intent, INTENT_POINTS, 0.0)
    return F.greatest(score, F.lit(0.1))
