"""A mailbox over the conversations table: each turn is a message whose head is one of a few fixed ones, in which every
rule has something to find, and whose body goes on with the turn's text; for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("id", "sender", "subject", "body")
ROWS = (
    (1, "Boss <ceo@corp.example>", "URGENT: server down", "Please fix this immediately, the deadline today is 5 PM. Call 555-123-4567."),
    (2, "calendar@corp.example", "Meeting: quarterly review", "Can you send the agenda before 10? We meet tomorrow in the zoom room."),
    (3, "billing@stripe.example", "Receipt for order #4471", "Your payment of $1,250.00 was received on 03/14/2024. Invoice attached."),
    (4, "promo@deals.example", "50% off sale", "Limited time offer! Use coupon SAVE at https://deals.example/sale?x=1 before 12-31-2024."),
    (5, "news@blog.example", "Weekly digest", "The newsletter: updates from our blog. unsubscribe at http://blog.example/out"),
    (6, "noreply@bank.example", "Security alert: suspicious login", "Verify your account. A password reset was requested. Unauthorized access is critical."),
    (7, "ann@friends.example", "Dinner on the weekend?", "Family party for the birthday on March 3, 2024. What is a good time?"),
    (8, "support@shop.example", "Issue with your order", "I am disappointed, the lamp is broken and not working. I demand refund of $40."),
    (9, "hr@corp.example", "FYI: policy update", "For your information, here is the report. No rush, whenever you can."),
    (10, "bob@corp.example", "", "Following up on my previous email, any updates on the status of the project?"),
    (11, "", "Hello", "See you."),
    (12, "Carl <carl@home.example>", "Re: notes", "Thanks, sounds good.\n\nThanks,\nCarl\nSent from my phone"),
    (13, "dora@corp.example", "Fwd: contract", "---- Forwarded message ----\nFrom: x\n> old line\nNew line here\nBegin forwarded message: end"),
    (14, "legal@corp.example", "Notice", "Body text stays.\nThis email and any files transmitted with it are confidential and secret."),
    (15, "eve@corp.example", "Could you clarify how to register?", "When will the system update be finished? Contact eve.k@corp.example or 555.987.6543."),
    (16, "Boss <ceo@corp.example>", "Action required: approve", "Please review and confirm by 17:30. It is due in 2 hours, end of day at the latest."),
)


def frame(t) -> DataFrame:
    """id, sender, subject, body."""
    heads = F.broadcast(t.spark.createDataFrame([(i - 1, *rest) for i, *rest in ROWS], "k long, sender string, subject string, head string"))
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(ROWS))).cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.join(heads, "k").select("id", "sender", "subject", F.concat("head", F.lit("\n"), "text").alias("body"))


def quoted(x) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


#: A CTE named mail with the same rows.
SQL = "mail as (select cast(c.conv_id * 1000 + c.turn as bigint) id, sender, subject, v.body || chr(10) || coalesce(c.text, '') body from conversations c join (values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in ROWS) + f") v(id, sender, subject, body) on (c.conv_id + c.turn) % {len(ROWS)} = v.id - 1)"
#: The lowered texts s, b, f (sender) and t (subject and body).
LOWERED = SQL + ", low as (select id, lower(subject) s, lower(body) b, lower(sender) f, lower(subject) || ' ' || lower(body) t from mail)"
