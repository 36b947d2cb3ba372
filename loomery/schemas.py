"""Row types and value sets of labelled messages."""

from __future__ import annotations

from pyspark.sql import types as T

# Label sets, sources of labels, id prefixes in order of precedence, languages.
INTENTS = ("request", "question", "meeting", "notification", "promotion", "complaint", "follow_up", "information", "security", "transactional", "other")
PRIORITIES = ("high", "medium", "low")
LABEL_SOURCES = ("rules", "llm", "human", "user_feedback", "ground_truth")
PREFIXES = ("enron", "spam", "phishing", "synthetic", "inbox")
LANGUAGES = ("en", "de", "fr", "es", "unknown")
# Labels of two sources and what they mean; null: excluded.
LABEL_MAP = {
    ("enron", "ACTION_REQUIRED"): "request", ("enron", "positive"): "request", ("enron", "NO_ACTION_REQUIRED"): None, ("enron", "negative"): None,
    ("massive", "email_sendemail"): "request", ("massive", "email_addcontact"): "request", ("massive", "email_query"): "information", ("massive", "email_querycontact"): "information",
}

EXAMPLE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("body", T.StringType()), T.StructField("intent", T.StringType()),
    T.StructField("priority", T.StringType()), T.StructField("source", T.StringType()), T.StructField("label_source", T.StringType()), T.StructField("label_confidence", T.DoubleType()),
    T.StructField("rule_score", T.DoubleType()), T.StructField("language", T.StringType()), T.StructField("is_synthetic", T.BooleanType()),
])
