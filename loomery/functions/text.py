"""Text kernel: normal forms, cleaners, extractors. Columns in, columns out; null texts are empty."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Fixed patterns: addresses, phones, links, money and dates in messages.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
LINK = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\$$\$$,]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
MONEY = r"\$\d+(?:,\d{3})*(?:\.\d{2})?"
DATES = (r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b\d{1,2}-\d{1,2}-\d{4}\b", r"\b\w+ \d{1,2}, \d{4}\b")
#: Fixed replacements of HTML entities, in order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&hellip;", "..."))
#: Fixed patterns of boilerplate: forwarded headers, disclaimers (to the end), sign-offs (to the end).
FORWARDED = (r"-+\s*Forwarded message\s*-+", r"-+\s*Original Message\s*-+", r"From:\s*.*?\nSent:\s*.*?\nTo:\s*.*?\nSubject:\s*.*", r"Begin forwarded message:")
DISCLAIMERS = (
    "this email and any files transmitted with it are confidential.*",
    "if you have received this email in error please notify.*",
    "the contents of this email message and any attachments are intended solely.*",
)
SIGN_OFF = r"\n\s*(?:thanks|best regards|kind regards|cheers|sincerely|warm regards|regards|yours truly|best),?\s*\n.*$"
#: Characters that end a line for Python's splitlines.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CELL_LIMIT, CELL_MARKER = 32_767, " [TRUNCATED]"


def text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def squeeze(col: Column) -> Column:
    """White space runs (Unicode) become one space."""
    return F.regexp_replace(col, r"(?U)\s+", " ")


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


@pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(col: Column) -> Column:
    """Compatibility composition; ASCII texts skip the Python worker's work by the guard on the branch."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), _nfkc(col)).otherwise(col)


def norm_basic(col: Column | str) -> Column:
    """N1: lower, white space to one space, stripped."""
    return strip(squeeze(F.lower(text(col))))


def norm_compat(col: Column | str) -> Column:
    """N2: NFKC, then N1."""
    return norm_basic(nfkc(text(col)))


def norm_content(subject: Column | str, body: Column | str) -> Column:
    """N3: subject and body on two lines, stripped, NFKC, then N1."""
    return norm_basic(nfkc(strip(F.concat(text(subject), F.lit("\n"), text(body)))))


def norm_fields(subject: Column | str, body: Column | str) -> Column:
    """N5: each field lower, line ends as LF, white space squeezed and stripped, then joined by LF."""
    one = lambda c: strip(squeeze(F.regexp_replace(F.lower(text(c)), "\r\n?", "\n")))
    return F.concat(one(subject), F.lit("\n"), one(body))


def norm_split(col: Column | str) -> Column:
    """N7: words of the lowered text joined by one space."""
    return F.array_join(words(F.lower(text(col))), " ")


def words(col: Column) -> Column:
    return F.filter(F.split(col, r"(?U)\s+"), lambda w: w != "")


def word_hashes(col: Column) -> Column:
    """Words as 64-bit hashes: joins on them move and compare longs."""
    return F.transform(words(col), lambda w: F.xxhash64(w))


def drop_quoted(col: Column) -> Column:
    """Lines that begin with > go."""
    lines = F.filter(F.split(col, LINE_ENDS), lambda x: ~strip(x).startswith(">"))
    return F.array_join(lines, "\n")


def strip_boilerplate(col: Column | str, compat: bool = True) -> Column:
    """N6: forwarded headers, quoted lines, disclaimers and sign-offs go, then NFKC and N1."""
    out = text(col)
    for p in FORWARDED:
        out = F.regexp_replace(out, f"(?is){p}", "")
    out = drop_quoted(out)
    for p in (*DISCLAIMERS, SIGN_OFF):
        out = F.regexp_replace(out, f"(?is){p}", "")
    return norm_basic(nfkc(out) if compat else out)


def strip_html(col: Column | str) -> Column:
    out = F.regexp_replace(text(col), "<.*?>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def simplify(col: Column | str) -> Column:
    """Tags to spaces, links to [Link], white space squeezed and stripped."""
    out = F.regexp_replace(text(col), "<[^>]+>", " ")
    return strip(squeeze(F.regexp_replace(out, r"(?U)https?://\S+", "[Link]")))


#: Fixed patterns that a body loses: signature, forwarded header, original message, notice.
CLEANED = (r"--\s*\n.*$", r"From:.*?Subject:.*?\n", r"-----Original Message-----.*$", r"This email.*confidential.*$")


def clean_body(col: Column | str, limit: int = 3000) -> Column:
    """Blank lines, spaces and tabs collapse; signatures, forwarded headers and notices go; long bodies are cut."""
    out = F.regexp_replace(text(col), r"(?U)\n\s*\n", "\n\n")
    out = F.regexp_replace(F.regexp_replace(out, " +", " "), "\t+", " ")
    for p in CLEANED:
        out = F.regexp_replace(out, f"(?sm){p}", "")
    return strip(F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit), F.lit("... [truncated for processing]"))).otherwise(out))


def summary(col: Column | str, limit: int) -> Column:
    """Squeezed text, or its head cut at a word and three dots."""
    clean = squeeze(strip(text(col)))
    head = F.substring(clean, 1, max(0, limit - 3))
    cut = F.regexp_replace(head, "(?s) [^ ]*$", "")
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.when(cut != "", cut).otherwise(head), F.lit("...")))


def subject_of(col: Column | str) -> Column:
    """What follows "subject:" on the first line that begins so."""
    return strip(F.regexp_extract(text(col), r"(?im)^\s*subject:(.*)$", 1))


def full_text(subject: Column | str, body: Column | str) -> Column:
    s, b = strip(text(subject)), strip(text(body))
    return F.when(s != "", strip(F.concat(F.lit("Subject: "), s, F.lit("\nBody: "), b))).otherwise(b)


def sanitize_xml(col: Column | str) -> Column:
    """Line ends as LF; characters outside XML 1.0 go."""
    out = F.replace(F.replace(text(col), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(out, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def truncate_cell(col: Column, limit: int = CELL_LIMIT, marker: str = CELL_MARKER) -> Column:
    """The text, or its head and the marker within the limit; no marker if it doesn't fit."""
    head = F.concat(F.substring(col, 1, limit - len(marker)), F.lit(marker)) if limit > len(marker) else F.substring(col, 1, limit)
    return F.when(F.length(col) > limit, head).otherwise(col)


def all_of(col: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(text(col), F.lit(pattern), F.lit(0))


def entities(col: Column | str) -> Column:
    return F.struct(
        all_of(col, EMAIL).alias("emails"), all_of(col, PHONE).alias("phones"), all_of(col, LINK).alias("urls"), all_of(col, MONEY).alias("money"),
        F.concat(*(all_of(col, p) for p in DATES)).alias("dates"),
    )


def address(col: Column | str) -> Column:
    """The address in angle brackets, else the first one, else the text as it is."""
    inner, bare = F.regexp_extract(text(col), "<([^>]+)>", 1), F.regexp_extract(text(col), EMAIL, 0)
    return F.when(inner != "", inner).when(bare != "", bare).otherwise(text(col))


def key_sentences(col: Column | str, top: int, important: list[str]) -> Column:
    """The sentences with the highest scores, ties in text order: 0.1 a word and 2 an important word.

    Sentences come from a squeezed text, so words are one more than spaces; scores count tenths in whole numbers.
    """
    parts = F.filter(F.split(simplify(col), " ?[.!?]+ ?"), lambda x: x != "")
    held = lambda s: sum((F.lower(s).contains(w).cast("int") * 20 for w in important), F.lit(0))
    scored = F.transform(parts, lambda s, i: F.struct((-(F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1 + held(s))).alias("s"), i.alias("i"), s.alias("t")))
    return F.transform(F.slice(F.array_sort(scored), 1, top), lambda x: x["t"])
