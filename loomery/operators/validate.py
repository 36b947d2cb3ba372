"""Canonical rows, violations, label mapping with reasons: expressions over loosely typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import strip, text


def namespaced(source: Column, raw: Column) -> Column:
    """The id with a source prefix, unless it has one; blank ids are 000000."""
    raw = strip(text(raw))
    raw = F.when(raw == "", "000000").otherwise(raw)
    prefix = F
    for p in S.PREFIXES[:-1]:
        prefix = prefix.when(F.lower(source).contains(p), p)
    has = F.lit(False)
    for p in S.PREFIXES:
        has = has | raw.startswith(p + "_")
    return F.when(has, raw).otherwise(F.concat(prefix.otherwise(S.PREFIXES[-1]), F.lit("_"), raw))


def first_present(*cols: str) -> Column:
    """Fallback on missing values."""
    return F.coalesce(*map(F.col, cols))


def first_filled(*cols: str) -> Column:
    """Fallback on blank values."""
    return F.coalesce(*(F.nullif(strip(F.col(c)), F.lit("")) for c in cols), F.lit(""))


def clamped(col: Column, otherwise: float) -> Column:
    """A number in 0-1; what can't be parsed is `otherwise`."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col.try_cast("double"), F.lit(otherwise))))


def truthy(col: Column) -> Column:
    return F.lower(strip(text(col))).isin("true", "1", "yes", "y", "t")


def canonical(df: DataFrame) -> DataFrame:
    """Typed rows of schemas.EXAMPLE from string columns (id, source, subject, body, intent, priority, confidence, label_source, language)."""
    source = strip(F.coalesce("source", F.lit("synthetic")))
    label_source = F.lower(strip(F.coalesce("label_source", F.lit("rules"))))
    return df.select(
        namespaced(source, F.col("id")).alias("id"), strip(text("subject")).alias("subject"), strip(text("body")).alias("body"), F.lower(strip(F.coalesce("intent", F.lit("other")))).alias("intent"),
        F.lower(strip(F.coalesce("priority", F.lit("low")))).alias("priority"), source.alias("source"), F.when(label_source.isin(*S.LABEL_SOURCES), label_source).otherwise("rules").alias("label_source"),
        clamped(F.col("confidence"), 1.0).alias("label_confidence"), F.coalesce("language", F.lit("en")).alias("language"), F.lower(source).contains("synthetic").alias("is_synthetic"),
    )


def violations() -> Column:
    """What a canonical row breaks, in order of the checks; empty if valid."""
    prefixed = F.lit(False)
    for p in S.PREFIXES:
        prefixed = prefixed | F.col("id").startswith(p + "_")
    tests = [
        (F.col("id") == "", "id: empty"), (~prefixed, "id: prefix"), (F.col("body") == "", "body: empty"), (~F.col("intent").isin(*S.INTENTS), "intent: unknown"),
        (~F.col("priority").isin(*S.PRIORITIES), "priority: unknown"), (~F.col("language").isin(*S.LANGUAGES), "language: unknown"), (~F.col("label_confidence").between(0.0, 1.0), "confidence: range"),
    ]
    return F.array_compact(F.array(*(F.when(test, what) for test, what in tests)))


def mapped(df: DataFrame, dataset: str, label: str) -> DataFrame:
    """df with intent and reason (null intent: excluded). The mapping table is joined, broadcast by its size."""
    rows = [(d, l, i, True) for (d, l), i in S.LABEL_MAP.items()]
    table = df.sparkSession.createDataFrame(rows, "_d string, _l string, intent string, known boolean")
    out = df.join(table, (F.lower(dataset) == F.col("_d")) & (F.col(label) == F.col("_l")), "left")
    direct = F.when(F.col(label).isin(*S.INTENTS), F.col(label))
    intent = F.coalesce("intent", direct)
    reason = F.when(intent.isNotNull(), "").when(F.col("known"), "excluded by mapping").otherwise("unmapped label")
    return out.withColumns({"intent": intent, "reason": reason}).drop("_d", "_l", "known")


def present(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with every named column, null in the named type where it has none; other columns stay."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c.lower() not in have})


def class_name(value: Column, names: list[str]) -> Column:
    """The name of a class given by number or name; unknown values are null."""
    at = value.try_cast("int")
    table = F.array(*map(F.lit, names))
    return F.when(at.between(0, len(names) - 1), F.get(table, at)).when(value.isin(*names), value)


def require(df: DataFrame, least: int, what: str) -> DataFrame:
    """df, or an error if it has fewer rows: no more than `least` rows are counted."""
    if df.limit(least).count() < least:
        raise ValueError(f"{what}: fewer than {least} rows")
    return df
