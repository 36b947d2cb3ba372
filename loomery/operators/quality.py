"""Distributions, cross-tabs, duplicate groups, integrity: reports over labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import quantiles


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def imbalance(counts: DataFrame, least: int = 10, ratio: float = 10.0) -> DataFrame:
    """Class counts with their ratio to the greatest and a warning for rare or dwarfed classes."""
    top = counts.agg(F.max("n").alias("top"))
    out = counts.crossJoin(F.broadcast(top)).withColumn("ratio", F.col("top") / F.col("n"))
    return out.withColumn("warning", F.when(F.col("n") < least, "rare").when(F.col("ratio") > ratio, "imbalanced").otherwise("")).drop("top")


def cross_tab(df: DataFrame, row: str, col: str, rows: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """Counts of every pair of values with zeros, and their share in the row. Values given, or those present."""
    spark, n = df.sparkSession, df.groupBy(row, col).agg(F.count("*").alias("n"))
    values = lambda c, given: spark.createDataFrame([(v,) for v in given], f"{c} string") if given else n.select(c).distinct()
    # both sides are class names: as many rows as there are labels
    grid = values(row, rows).crossJoin(F.broadcast(values(col, cols)))
    total = n.groupBy(row).agg(F.sum("n").alias("total"))
    out = grid.join(n, [row, col], "left").join(total, row, "left")
    n0 = F.coalesce("n", F.lit(0)).cast("long")
    return out.select(row, col, n0.alias("n"), F.when(F.col("total") > 0, n0 / F.col("total")).otherwise(0.0).alias("share"))


def length_stats(df: DataFrame, key: str, length: Column) -> DataFrame:
    x = df.withColumn("_x", length.cast("long"))
    return x.groupBy(key).agg(F.min("_x").alias("shortest"), F.max("_x").alias("longest"), F.round(F.avg("_x"), 2).alias("mean")).join(
        quantiles(x, [key], F.col("_x"), {"median": 0.5}), key
    )


def duplicate_groups(df: DataFrame, content: Column, source: str) -> DataFrame:
    """Contents that occur more than once: hash, rows and sources."""
    g = df.groupBy(F.md5(content).alias("hash")).agg(F.count("*").alias("n"), F.countDistinct(source).alias("sources"))
    return g.where("n > 1")


def coverage(df: DataFrame, key: str, content: Column, language: str) -> DataFrame:
    """Per key: rows, languages, empty contents, lengths, distinct contents, and those shared with another key."""
    x = df.withColumns({"_c": content, "_l": F.length(content)})
    # one row for each content and key first: the counts of contents then need no distinct
    per = x.groupBy(F.md5("_c").alias("hash"), key).agg(F.count("*").alias("n"))
    spread = per.groupBy("hash").agg(F.count("*").alias("keys"))
    shared = per.join(spread, "hash").groupBy(key).agg(F.count("*").alias("distinct_contents"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("long").alias("repeated_contents"), F.sum(F.when(F.col("keys") > 1, 1).otherwise(0)).cast("long").alias("shared_contents"))
    stats = x.groupBy(key).agg(
        F.count("*").alias("n"), F.countDistinct(language).alias("languages"), F.sum(F.when(F.col("_c") == "", 1).otherwise(0)).cast("long").alias("empty"),
        F.min("_l").cast("long").alias("shortest"), F.max("_l").cast("long").alias("longest"), F.round(F.avg("_l"), 2).alias("mean_length"),
    )
    return stats.join(shared, key).join(quantiles(x, [key], F.col("_l"), {"median_length": 0.5}), key)


def conflicts(df: DataFrame, key: Column, label: str) -> DataFrame:
    """Keys that repeat: rows, distinct labels, and whether labels disagree."""
    g = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.countDistinct(label).alias("labels"))
    return g.where("n > 1").withColumn("conflicting", F.col("labels") > 1)
