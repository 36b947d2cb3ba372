"""Group-isolated, stratified train/val/test splits.

Rows that share a group (a near-duplicate cluster) go to one split. A group's tier is its rarest class. Tiers are dealt from
the rarest class on, each in the seeded order of its groups: the first go to train, the next to val, and so on, and the
cuts lie where the class has what it lacks of its targets after the rarer tiers. A cut is a hash, found by counting
groups by its first digits and then, only where the cut falls, by the next ones: three aggregates or four a class, whatever
the number of groups or of different class counts, and at most 4,096 rows for each cut to the driver.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import seeded
from .tables import drop, keep_table

SPLITS = {"train": 0.70, "val": 0.15, "test": 0.15}
#: Hexadecimal digits of the seeded order that a count looks at.
DIGITS = 3


def cuts(tier: DataFrame, needs: list[float]) -> list[str]:
    """For each need, the hash below which the groups of a tier (k, n) hold that many rows, give or take half a group."""
    open_, found = {i: ("", 0.0) for i in range(len(needs))}, [""] * len(needs)
    while open_:
        prefixes = sorted({p for p, _ in open_.values()})
        depth = len(prefixes[0])
        some = tier.where(F.substring("k", 1, depth).isin(*prefixes)) if depth else tier
        counted = some.groupBy(F.substring("k", 1, depth).alias("p"), F.substring("k", depth + 1, DIGITS).alias("d")).agg(F.sum("n").alias("n"), F.count("*").alias("groups")).collect()
        by = defaultdict(list)
        for r in sorted(counted, key=lambda r: r["d"]):
            by[r["p"]].append(r)
        for i, (prefix, below) in list(open_.items()):
            del open_[i]
            found[i] = prefix + "g"  # beyond all digits: every group is below
            for r in by[prefix]:
                if below + r["n"] > needs[i]:
                    here = prefix + r["d"]
                    if r["groups"] == 1 or depth + DIGITS >= 32:
                        found[i] = here + "g" if needs[i] - below >= r["n"] / 2 else here
                    else:
                        open_[i] = here, below
                    break
                below += r["n"]
    return found


def group_split(df: DataFrame, group: str, label: str, ratios: dict[str, float] = SPLITS, seed: int = 42) -> DataFrame:
    """df with a column split. Rows without a group are left out; a null label is a class of its own."""
    per = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("c")).agg(F.count("*").alias("n"))
    per = keep_table(per)
    total = {r["c"]: r["n"] for r in per.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    order = sorted(total, key=lambda c: (total[c], c))
    ranks = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(order)), "at int, c string"))
    tiers = per.join(ranks, "c").groupBy("g").agg(F.min("at").alias("tier")).withColumn("k", seeded(seed, "g"))
    counts = keep_table(per.join(tiers, "g").select("g", "k", "tier", "c", "n"))
    drop(per)
    have, rows, names = {s: dict.fromkeys(order, 0) for s in ratios}, [], list(ratios)
    for at, c in enumerate(order):
        tier = counts.where(F.col("tier") == at)
        needs, edge = [], 0.0
        for s in names[:-1]:
            edge += max(0.0, ratios[s] * total[c] - have[s][c])
            needs.append(edge)
        edges = ["", *cuts(tier.where(F.col("c") == c), needs), "h"]
        mine = [(at, lo, hi, s) for s, lo, hi in zip(names, edges[:-1], edges[1:], strict=True) if lo < hi]
        rows += mine
        of = F
        for _, lo, hi, s in mine:
            of = of.when((F.col("k") >= lo) & (F.col("k") < hi), s)
        for r in tier.groupBy(of.alias("s"), "c").agg(F.sum("n").alias("n")).collect():
            have[r["s"]][r["c"]] += r["n"]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "tier int, lo string, hi string, split string"))
    placed = counts.select("g", "k", "tier").distinct().join(table, "tier").where("k >= lo and k < hi").select(F.col("g").alias(group), "split")
    return df.join(placed, group)


def joint_label(df: DataFrame, first: str, second: str, least: int = 3) -> DataFrame:
    """df with `stratum`: both labels, or the first alone for all rows if some pair has fewer than `least`."""
    pairs = df.groupBy(first, second).agg(F.count("*").alias("n"))
    rare = pairs.agg((F.min("n") < least).alias("rare"))
    both = F.concat_ws("|", first, second)
    return df.crossJoin(F.broadcast(rare)).withColumn("stratum", F.when(F.col("rare"), F.col(first).cast("string")).otherwise(both)).drop("rare")
