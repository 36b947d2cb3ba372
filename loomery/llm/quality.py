"""Quality rules: an isolation forest on rule statistics, with its threshold calibrated from labelled rows.

Words are runs of bytes other than space and 09-0D. Statistics cover the whole text. Labelled rows are dealt by a hash
of their id into three parts, PARTS: the forest is fitted on the first, on about FIT_ROWS rows of it at most (a
documented bound; each tree sees PSI clean ones); every row is scored by its mean path length over the random splits.
The threshold is the one with the best F1 on the whole second part among those that reject at most FALSE_REJECTS of its
clean rows, from counts per score bin; the third part is seen by neither and tells how well the verdicts hold.

Null texts have no words. Repeated rows are scored alike. Labels of a repeated doc_id: the lowest counts. Without
labelled rows of either quality in a part that needs them, or on an empty table, only the base rules reject.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import BROADCAST_IDS, drop, materialize, small_batches, tidy

TREES, PSI, DEPTH, FIT_ROWS, BINS, FALSE_REJECTS = 200, 256, 12, 20_000, 2000, 0.002
#: Tenths of the labelled rows that fit, calibrate and are held out.
PARTS = {"fit": (0, 5), "calibrate": (5, 8), "held_out": (8, 10)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
SPACE = b" \t\n\r\x0b\x0c"
#: Bytes to delete so that what is left are the characters counted.
NOT_STARTS = SPACE + bytes(range(0x80, 0xC0))
SYMBOLS, UPPER, DIGITS, MARKS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b"!?.,;:"


def counts(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    repeat = 0
    if n:
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        v = len(seen)
        if n > 3 and v < n:
            three = (ids[:-2] * v + ids[1:-1]) * v + ids[2:] if v < 2_000_000 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
            order = three.argsort(kind="stable")
            twin = three[order[1:]] == three[order[:-1]]
            again = np.zeros(n - 2, bool)
            again[order[1:][twin]] = again[order[:-1][twin]] = True
            if twin.any():
                mark = np.zeros(n, bool)
                for k in range(3):
                    mark[k : n - 2 + k] |= again
                repeat = int(mark.sum())
    gone = lambda chars: len(text) - len(text.translate(None, chars))
    return n, len(text.translate(None, NOT_STARTS)), gone(SYMBOLS), len(lines) - len(set(lines)), repeat, len(lines), gone(UPPER), gone(DIGITS), gone(MARKS), len(seen)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text) and COUNTS."""
    small_batches(docs.sparkSession)

    def stat(batches):
        for b in batches:
            cols = list(zip(*(counts(t or b"") for t in b.column(2).to_pylist()))) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "text_key", *COUNTS])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("t")).mapInArrow(tidy(stat), f"doc_id {kind}, text_key long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """All statistics as values from 0 to 1 that hardly follow from a text's length; square roots spread the small ones.

    Distinct words count by logarithms, as their plain share falls with length; mean word length m is m / (m + 10).
    """
    chars, words, lines = (np.maximum(c[n].astype(float), 1) for n in ("word_chars", "n_words", "n_lines"))
    shares = [c[n] / chars for n in ("n_symbols", "n_upper", "n_marks", "n_digits")]
    shares += [c["n_dup_lines"] / lines, c["n_repeat_words"] / words]
    same = 1 - np.log(np.maximum(c["n_distinct"], 1)) / np.log(np.maximum(words, 2))
    return np.sqrt(np.clip(np.stack([*shares, same, chars / (chars + 10 * words)], axis=1), 0, 1))


def mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def fit_forest(x: np.ndarray, box: tuple[np.ndarray, np.ndarray], seed: int = 42) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays (feature or -1, threshold or path length at a leaf, left child); the right child follows the left.

    Splits are drawn over the box of all labelled rows, cut down on the way, and not over the clean rows of a node
    alone: what no clean row has, such as symbols, is then isolated early and not overlooked.
    """
    rng, trees = np.random.default_rng(seed), []
    for _ in range(TREES):
        rows = x[rng.choice(len(x), min(PSI, len(x)), replace=False)]
        feature, value, left, todo = [-1], [0.0], [0], [(0, rows, 0, *box)]
        while todo:
            node, r, depth, low, high = todo.pop()
            open_ = np.flatnonzero(high > low)
            if depth >= DEPTH or len(r) < 2 or not len(open_):
                value[node] = depth + mean_path(len(r))
                continue
            f = rng.choice(open_)
            feature[node], value[node], left[node] = f, (cut := rng.uniform(low[f], high[f])), len(feature)
            side = r[:, f] < cut
            for k, part in enumerate((r[side], r[~side])):
                to_low, to_high = low.copy(), high.copy()
                (to_low if k else to_high)[f] = cut
                todo.append((left[node] + k, part, depth + 1, to_low, to_high))
            feature += [-1, -1]
            value += [0.0, 0.0]
            left += [0, 0]
        trees.append((np.array(feature, np.int8), np.array(value, np.float32), np.array(left, np.int16)))
    return trees


def anomaly(trees: list[tuple[np.ndarray, ...]], x: np.ndarray, psi: int) -> np.ndarray:
    """2 to the power of minus the mean path length over its expectation: near 1 for anomalies."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, value, left in trees:
        at = np.zeros(len(x), np.int64)
        while (go := feature[at] >= 0).any():
            i, node = rows[go], at[go]
            right = x[i, feature[node]] >= value[node]
            at[i] = left[node].astype(np.int64) + right
        total += value[at]
    return 2.0 ** -(total / len(trees) / max(mean_path(psi), 1e-9))


def score(stats: DataFrame, trees: list[tuple[np.ndarray, ...]], psi: int) -> DataFrame:
    """stats with the column score."""

    def run(batches):
        for b in batches:
            x = features({c: b.column(b.schema.get_field_index(c)).to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(anomaly(trees, x, psi))], names=[*b.schema.names, "score"])

    return stats.mapInArrow(tidy(run), T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType())]))


def part(name: str):
    """Whether a labelled doc_id is in a part of PARTS."""
    low, high = PARTS[name]
    return F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id").cast("string")), F.lit(10)).between(low, high - 1)


def threshold(scored: DataFrame) -> float:
    """Best F1 over the calibrating rows that the base rules keep, with few clean rows lost."""
    rows = scored.where(part("calibrate")).where("quality is not null and not base_failed").groupBy("quality", F.floor(F.col("score") * BINS).alias("bin")).count().collect()
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in rows:
        (good if r["quality"] else bad)[r["bin"]] += r["count"]
    lost, caught = good[::-1].cumsum()[::-1], bad[::-1].cumsum()[::-1]
    f1 = np.where(lost <= FALSE_REJECTS * good.sum(), 2 * caught / np.maximum(caught + lost + bad.sum(), 1), -1)
    at = len(f1) - 1 - f1[::-1].argmax()
    return at / BINS if f1[at] > 0 else 2.0


def truth_of(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, COUNTS, base_failed, score, kept: one row per row of docs."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialize(statistics(docs, id_col, text_col).withColumn("base_failed", failed), "statistics")
    truth = truth_of(labels)
    fit = materialize(stats.join(truth, "doc_id").where("not base_failed").where(part("fit")).select("doc_id", "quality", *COUNTS), "fit")
    share = FIT_ROWS / max(fit.count(), 1)
    if share < 1:  # the lowest hashes of doc_id: the same rows whatever files and tasks hold them
        fit = fit.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), F.lit(2**40)) < int(share * 2**40))
    fit = fit.drop("doc_id").toPandas().sort_values(["quality", *COUNTS])  # FIT_ROWS rows, give or take a few hundred
    x = features({c: fit[c].to_numpy() for c in COUNTS})
    clean = x[fit["quality"].to_numpy() == 1]
    if len(clean) < 2:
        return stats.withColumn("score", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    trees = fit_forest(clean, (x.min(0), x.max(0)))
    done = materialize(score(stats, trees, min(PSI, len(clean))), "scores")
    drop(stats)
    cut = threshold(done.join(truth, "doc_id", "left"))
    return done.withColumn("kept", ~F.col("base_failed") & (F.col("score") < cut))


def held_out(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """quality, rows, kept: labelled rows of the held-out part that the base rules keep."""
    rows = judged.join(truth_of(labels), "doc_id").where("not base_failed").where(part("held_out"))
    return rows.groupBy("quality").agg(F.count("*").alias("rows"), F.count_if("kept").alias("kept"))


def passed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept."""
    out = judge(docs, labels).where("not kept").select(F.col("doc_id").alias("_lm_id"), F.col("text_key").alias("_lm_key")).distinct()
    out = materialize(out, "rejected", docs.count())
    if out.count() <= BROADCAST_IDS:
        out = F.broadcast(out)
    return docs.join(out, F.col("doc_id").eqNullSafe(F.col("_lm_id")) & (F.xxhash64("text") == F.col("_lm_key")), "left_anti")
