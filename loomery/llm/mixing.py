"""Mixing sources to target weights: hash-random order, range sort, distributed prefix sums, exact budget cuts.

Size of a row: its words, runs of characters other than space and 09-0D (null text: 0). Sources in code point order,
null last, take the given weights in turn and share the total size; a target stops at `repeats` times its source's
size and the excess goes to the others by weight. A source's rows stand in the order of 60 bits of
a seeded md5 of doc_id, which any engine reproduces; each
is taken floor(target / source size) times, and rows of one more epoch until the budget, the last one in part.

One row per source comes to the driver to fix the targets. Null doc_ids hash like any value; repeated rows are rows of
their own, and equal rows share their takes in any order. Sources without words have target 0. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import with_prefix
from .workspace import drop, materialize

#: Decisions (some 100 bytes each in memory) that may be broadcast to the texts; more are joined by a shuffle.
BROADCAST_TAKEN = 300_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], repeats: int) -> list[float]:
    """Shares of the total by weight, none above repeats times its size."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] > repeats * sizes[i]}
        for i in full or free:
            out[i] = float(repeats * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        free -= full
        left -= sum(out[i] for i in full)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of docs."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    sized = materialize(sized.withColumn("key", key), "sizes")
    order = [F.asc_nulls_last("source"), F.asc("key"), F.asc("doc_id"), F.asc("size")]
    per = sized.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.asc_nulls_last("source")).collect()
    totals = [r["n"] for r in per]
    goal = targets(totals, [weights[i % len(weights)] for i in range(len(per))], repeats)
    rows, start = [], 0
    for r, t in zip(per, goal):
        whole = min(int(t // r["n"]), repeats) if r["n"] else 0
        rows.append((r["source"], r["n"], t, start, whole, round(t - whole * r["n"])))
        start += r["n"]
    plan = docs.sparkSession.createDataFrame(rows, "s string, source_size long, target double, start long, whole long, rest long")
    ordered = with_prefix(sized, order, "size", "mixed")
    drop(sized)
    placed = ordered.join(plan, F.col("source").eqNullSafe(F.col("s")))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - (F.col("_before") - F.col("start"))))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as often as the mix takes them; the document at a source's cut is shortened to the words taken.

    Rows that repeat an id with as many words are taken as one of them, as often as all of these together.
    """
    took = mix(docs, **how).where("taken > 0").groupBy(F.col("doc_id").alias("_lm_id"), F.col("source").alias("_lm_source"), F.col("size").alias("_lm_n"))
    took = materialize(took.agg(F.sum("taken").alias("_lm_taken"), F.count("*").alias("_lm_rows")), "taken", docs.count())
    again = took.where("_lm_rows > 1").select("_lm_id").distinct()
    repeats = again.count()
    if took.count() <= BROADCAST_TAKEN:
        took = F.broadcast(took)
    sized = docs.withColumn("_lm_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    if repeats:
        mine = sized.join(F.broadcast(again) if repeats <= BROADCAST_TAKEN else again, F.col("doc_id").eqNullSafe(F.col("_lm_id")), "left_semi").where("_lm_size > 0")
        one = mine.groupBy("doc_id", "source", "_lm_size").agg(F.min(F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "source", "text")))).alias("_lm_row"))
        one = one.select(*("doc_id" if c == "doc_id" else "source" if c == "source" else F.col(f"_lm_row.{c}") for c in docs.columns), "_lm_size")
        sized = sized.join(F.broadcast(again) if repeats <= BROADCAST_TAKEN else again, F.col("doc_id").eqNullSafe(F.col("_lm_id")), "left_anti").unionByName(one)
    same = F.col("doc_id").eqNullSafe(F.col("_lm_id")) & F.col("source").eqNullSafe(F.col("_lm_source")) & (F.col("_lm_size") == F.col("_lm_n"))
    both = sized.join(took, same)
    both = both.withColumn("_lm_take", F.explode(F.expr("transform(sequence(1L, bigint(ceil(_lm_taken / _lm_size))), i -> least(_lm_size, _lm_taken - (i - 1) * _lm_size))")))
    words = F.slice(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1), F.lit(1), F.col("_lm_take").cast("int"))
    text = F.when(F.col("_lm_take") < F.col("_lm_size"), F.array_join(words, "")).otherwise(F.col("text"))
    return both.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
