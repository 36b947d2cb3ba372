"""Secret scans by corpus-wide ownership frequency.

Candidates come from fixed patterns and, beyond them, from opaque tokens. Every candidate's value is hashed, and hashes
are counted over distinct repositories and owners: values that many owners carry are copied examples, values of fewer
owners that look random are live credentials: a copy or two of a document don't make its secrets public. Raw values
never leave the scan.

Spans count code points, end exclusive. Pattern spans are always kept; opaque tokens become spans only if live.
Null texts are empty; null owners and repositories count as one of their own. Repeated rows get equal results.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialize, small_batches, tidy

#: Fixed patterns: kind, pattern, group of the secret, least length of it. Letters of the names stand in either case.
PATTERNS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
KINDS = (*(p[0] for p in PATTERNS), "opaque")
#: An opaque token: so many characters, with letters and digits, and so many bits a character.
OPAQUE, OPAQUE_LENGTH, ENTROPY = r"[A-Za-z0-9+/_=-]+", 20, 3.0
#: Distinct owners from which on a value is a copied example.
COPIED_OWNERS = 3
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def live_looking(value: str) -> bool:
    """Letters and digits, many different characters: not a word, a counter or a placeholder."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= ENTROPY


def finder():
    """text -> [(start, kind number, end, value)], sorted."""
    name, rest = PATTERNS[0][1].split(")", 1)
    assign = re.compile(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", name) + ")" + rest)
    access, runs, opaque = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}"), re.compile(OPAQUE[:-1] + "{%d,}" % OPAQUE_LENGTH)

    def find(text: str) -> list[tuple[int, int, int, str]]:
        low = text.encode().lower()
        out = []
        if any(n in low for n in NAMES):
            out += [(m.start(), 0, m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end(), m[0]) for m in access.finditer(text)]
        out += [(m.start(), 2, m.end(), m[0]) for m in runs.finditer(text)]
        if free := [m for m in opaque.finditer(text) if live_looking(m[0])]:
            out += [(m.start(), 3, m.end(), m[0]) for m in free if not any(s < m.end() and m.start() < e for s, _, e, _ in out)]
        return sorted(out)

    return find


def row_key(id_col: str, text_col: str) -> Column:
    """Digest of id and text in which null, empty and every other value are written apart."""
    i = F.col(id_col).cast("string")
    name = F.when(i.isNull(), "-").otherwise(F.concat(F.length(i).cast("string"), F.lit(":"), i))
    return F.unhex(F.md5(F.concat(name, F.when(F.col(text_col).isNull(), "-").otherwise(F.concat(F.lit(":"), F.col(text_col))))))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """doc_id, text_key (digest of id and text), owner, repo, found: array of (start, kind, end, value's hash, looks live)."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary()), ("looks", pa.bool_())])

    def scan(batches):
        find = finder()
        for b in batches:
            found = [[dict(start=s, kind=k, end=e, value=hashlib.sha256(v.encode()).digest()[:16], looks=live_looking(v)) for s, k, e, v in find(t or "")] for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.list_(span))], names=[*b.schema.names[:4], "found"])

    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("text_key"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.coalesce(text_col, F.lit("")).alias("t"))
    return rows.mapInArrow(tidy(scan), f"doc_id {kind}, text_key binary, owner string, repo string, found array<struct<start: long, kind: int, end: long, value: binary, looks: boolean>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "repo") -> DataFrame:
    """doc_id, text_key, spans: array of (start, kind, end, owners, repos, verdict), by start and kind.

    verdict: copied (COPIED_OWNERS owners or more), live (fewer, looks random) or shared (fewer, doesn't look random).
    """
    found = materialize(candidates(docs, id_col, text_col, owner_col, repo_col), "candidates")
    rows = found.where("size(found) > 0").dropDuplicates(["text_key", "owner", "repo"]).select("text_key", "owner", "repo", F.inline("found"))
    pairs = rows.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    freq = pairs.groupBy("value", "owner").agg(F.count("*").alias("repos")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    freq = materialize(freq, "frequencies", found.count())  # a join of plain shuffles lets AQE split a value that is everywhere
    verdict = F.when(F.col("owners") >= COPIED_OWNERS, "copied").when(F.col("looks"), "live").otherwise("shared")
    judged = rows.join(freq, "value").withColumn("verdict", verdict).where((F.col("kind") < len(PATTERNS)) | (F.col("verdict") == "live"))
    judged = judged.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "owners", "repos", "verdict"))).alias("spans"))
    return found.select("doc_id", "text_key").join(judged, "text_key", "left").withColumn("spans", F.coalesce("spans", F.array().cast(dict(judged.dtypes)["spans"])))


def redact(docs: DataFrame, **columns) -> DataFrame:
    """docs with live credentials replaced by [kind]; copied and shared values stay. Other columns are left as they are."""
    live = scan(docs, **columns).select(F.col("text_key").alias("_lm_key"), F.filter("spans", lambda s: s["verdict"] == "live").alias("_lm_spans"))
    live = materialize(live.where("size(_lm_spans) > 0").dropDuplicates(["_lm_key"]), "live")
    joined = docs.withColumn("_lm_key", row_key("doc_id", "text")).join(live, "_lm_key", "left")
    names = F.array(*map(F.lit, KINDS))

    def add(acc, s):
        gap = F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(F.concat(acc["out"], gap, F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(new)

    done = F.aggregate("_lm_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), add, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return joined.withColumn("text", F.when(F.col("_lm_spans").isNotNull(), done).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
