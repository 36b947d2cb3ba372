"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import drop, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (node, component), the smallest id reachable; nodes without links are absent.

    Each round is a minimum per node (combined before the shuffle) and equi-joins, O(log n) rounds in practice;
    the minima are written first, so that AQE can split a hub's neighbours. Nulls and self-links are ignored. No links: an empty result.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    print_of = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
    seen = print_of(e)
    while seen[0]:
        both = e.union(e.select("b", "a"))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc", seen[0])
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        old, e = e, materialize(small.where("a <> b").distinct(), "cc", seen[0])
        drop(old, low)
        if (now := print_of(e)) == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
