"""Exact duplicates, near duplicates by words and characters, greedy survivors, splits and samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words as words_of
from .setjoin import Meetings, contained, gram_hashes, gram_similarity, word_numbers
from .setjoin import similar_pairs as similar_pairs
from .tables import small


def first_of(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row with the least order value of each key; a minimum combined before the shuffle picks it, no sort."""
    keyed = df.withColumn("_key", key)
    best = keyed.groupBy("_key").agg(F.min(order).alias("_best"))
    return keyed.join(best, "_key").where(F.col(order) == F.col("_best")).drop("_key", "_best")


def removed(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(removed, kept): each row that a smaller id has the same key as, and that id."""
    keyed = df.select(F.col(id_col).alias("removed"), key.alias("_key"))
    return keyed.join(keyed.groupBy("_key").agg(F.min("removed").alias("kept")), "_key").where("removed <> kept").select("removed", "kept")


def first_texts(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, rep): each row and the smallest id that has the same text."""
    keyed = df.select(F.col(id_col).alias("id"), F.md5(text).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("rep")), "key").select("id", "rep")


def classes(df: DataFrame, id_col: str, items: Column) -> DataFrame:
    """(id, rep, s): each row's set, and the smallest id that has the same set. Empty sets are classes of their own."""
    sets = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(items)).alias("s")).withColumn("key", F.xxhash64("s"))
    reps = sets.where("size(s) > 0").groupBy("key").agg(F.min("id").alias("rep"))
    return sets.join(reps, "key", "left").select("id", F.coalesce("rep", "id").alias("rep"), "s")


def grams(texts):
    """The character 4-gram set of each text."""
    return (np.unique(gram_hashes(t, 4)) for t in texts)


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, ca, cb): the pairs, a written table, with their texts (id, c), of which no others travel."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = texts.join(small(asked), "id", "left_semi")
    c = lambda x: texts.select(F.col("id").alias(x), F.col("c").alias(f"c{x}"))
    return pairs.select("a", "b").join(c("a"), "a").join(c("b"), "b")


def word_similarity(a: str, b: str) -> float:
    """Jaccard similarity of the sets of words between spaces; two without any are alike."""
    x, y = ({w for w in t.split(" ") if w} for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def similarities(pairs: DataFrame) -> DataFrame:
    """(a, b, word_sim, char_sim) of pairs (a, b, ca, cb): sets made here, for they are larger than the texts."""

    def run(batches):
        for x in batches:
            both = list(zip(x.column("ca").to_pylist(), x.column("cb").to_pylist()))
            sims = [pa.array([f(a, b) for a, b in both], pa.float64()) for f in (word_similarity, gram_similarity)]
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), *sims], names=["a", "b", "word_sim", "char_sim"])

    return pairs.select("a", "b", "ca", "cb").mapInArrow(run, "a long, b long, word_sim double, char_sim double")


class Texts:
    """Different normalised texts of `least` characters or more, which are read again for each step: give a written table.

    Two texts count as alike if the similarity of their word sets reaches `words` or that of their character 4-grams `chars`,
    the shorter being at least `ratio` of the longer. Give it one row for each distinct text, ids whole numbers.
    """

    def __init__(self, rows: DataFrame, id_col: str, text: Column, keep_table, words: float = 0.80, chars: float = 0.85, ratio: float = 0.70, least: int = 15):
        rows = rows.select(F.col(id_col).cast("long").alias("id"), text.alias("c")).where(F.length("c") >= least)
        self.ratio, self.keep = ratio, keep_table
        self.texts = rows
        self.met = Meetings(rows.withColumnRenamed("c", "t"), [(words, word_numbers), (chars, grams)], keep_table)

    def compared(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of like length, with word_sim and char_sim."""
        both = with_texts(pairs, self.texts).where(F.least(F.length("ca"), F.length("cb")) / F.greatest(F.length("ca"), F.length("cb")) >= self.ratio)
        return similarities(both)

    def pairs(self) -> DataFrame:
        """(a, b, word_sim, char_sim), a < b, of all pairs that meet: those alike by `words` or `chars`, and some others."""
        return self.compared(self.met.pairs())

    def links(self, accept) -> DataFrame:
        """(a, b): enough of the pairs that accept (compared pairs -> pairs) takes to join whatever all of them join."""
        return self.met.spanning(lambda p: accept(self.compared(p)), lambda e: components(e, self.keep))


def alike(rows: DataFrame, id_col: str, text: Column, keep_table, words: float = 0.80, chars: float = 0.85, **bounds) -> DataFrame:
    """(a, b, word_sim, char_sim), a < b: all pairs of Texts that are alike."""
    pairs = Texts(rows, id_col, text, keep_table, words, chars, **bounds).pairs()
    return pairs.where((F.col("word_sim") >= words) | (F.col("char_sim") >= chars))


def informative(rows: DataFrame, text: Column) -> DataFrame:
    """(word): words of 3 letters or more in 2 texts at least and in 20 or a fifth of all at most."""
    each = rows.select(F.explode(F.array_distinct(words_of(text))).alias("word")).where(F.length("word") >= 3)
    most = F.broadcast(rows.agg(F.greatest(F.lit(20), F.floor(F.count("*") * 0.2)).alias("most")))
    return each.groupBy("word").agg(F.count("*").alias("df")).where("df >= 2").join(most, F.col("df") <= F.col("most")).select("word")


def sharing(pairs: DataFrame, rows: DataFrame, id_col: str, text: Column, good: DataFrame) -> DataFrame:
    """The pairs that share a good word."""
    asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    each = rows.select(F.col(id_col).alias("id"), text.alias("t")).join(asked, "id", "left_semi").select("id", F.explode(F.array_distinct(words_of(F.col("t")))).alias("word"))
    mine = each.join(good, "word", "left_semi").groupBy("id").agg(F.collect_list(F.xxhash64("word")).alias("k"))
    k = lambda x: mine.select(F.col("id").alias(x), F.col("k").alias(f"k{x}"))
    return pairs.join(k("a"), "a").join(k("b"), "b").where(F.arrays_overlap("ka", "kb")).drop("ka", "kb")


def greedy_edges(rows: DataFrame, id_col: str, text: Column, keep_table, chars: float = 0.85, window: float = 0.4, least: int = 20, inside: int = 30) -> DataFrame:
    """(a, b), a < b, where the pass in id order drops b if it has kept a.

    One text stands in the other (both of `inside` characters), or their 4-grams reach `chars` and their lengths differ
    by less than `window` of the later one's; both of `least` characters.
    """
    rows = keep_table(rows.select(F.col(id_col).alias("id"), text.alias("c")).where(F.length("c") >= least))
    inner = contained(rows, "id", F.col("c"), rows.withColumnRenamed("id", "part"), "part", F.col("c"), inside).where("id <> part")
    rows = rows.withColumn("id", F.col("id").cast("long"))
    met = Meetings(rows.withColumnRenamed("c", "t"), [(chars, grams)], keep_table)
    both = with_texts(met.pairs(), rows).where(F.abs(F.length("cb") - F.length("ca")) < F.length("cb") * window)
    near = similarities(both).where(F.col("char_sim") >= chars)
    return near.select("a", "b").union(inner.select(F.least("id", "part"), F.greatest("id", "part"))).distinct()


def survivors(ids: DataFrame, edges: DataFrame, keep_table, most: int = 20_000) -> DataFrame:
    """Ids that a pass in id order keeps if it drops each row similar to an earlier kept one.

    The lexicographically first maximal independent set. Components of at most so many links are passed through in one
    step each; larger ones take rounds: a row without smaller undecided or kept neighbours is kept, its larger
    neighbours go. keep_table writes and rereads a table to end its lineage.
    """
    e = keep_table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    of = keep_table(components(e, keep_table))
    e = keep_table(e.join(of.withColumnRenamed("node", "a"), "a"))
    sized = e.groupBy("component").agg(F.count("*").alias("links"))
    e = e.join(sized, "component")

    def one_pass(batch):
        out: set = set()
        before: dict = {}
        for a, b in zip(batch["a"], batch["b"]):
            before.setdefault(b, []).append(a)
        for b in sorted(before):
            if not all(a in out for a in before[b]):
                out.add(b)
        return pd.DataFrame({"id": sorted(out)})

    kind = dict(e.dtypes)["a"]
    gone = keep_table(e.where(F.col("links") <= most).select("component", "a", "b").groupBy("component").applyInPandas(one_pass, f"id {kind}"))
    e = keep_table(e.where(F.col("links") > most).select("a", "b"))
    undecided = keep_table(e.select(F.col("a").alias("id")).union(e.select("b")).distinct())
    while not undecided.isEmpty():
        live = e.join(undecided.withColumnRenamed("id", "a"), "a", "left_semi").join(undecided.withColumnRenamed("id", "b"), "b", "left_semi")
        new = keep_table(undecided.join(live.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
        lost = keep_table(e.join(new.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        gone = keep_table(gone.union(lost))
        undecided = keep_table(undecided.join(new, "id", "left_anti").join(lost, "id", "left_anti"))
    return ids.select("id").join(gone, "id", "left_anti")


def components(edges: DataFrame, keep_table) -> DataFrame:
    """(node, component): the smallest node reachable, by star rounds over written tables."""
    e = keep_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()) != seen and now[0]:
        seen = now
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = keep_table(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = keep_table(small.where("a <> b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def seeded(seed: int, id_col: str) -> Column:
    """A pseudo-random order key that any engine with md5 reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def ratio_split(df: DataFrame, id_col: str, ratios: dict[str, float], seed: int = 42, strata: list[str] | None = None) -> DataFrame:
    """Exact shares by rank in a seeded order, of each stratum apart: all but the last part hold floor(n * ratio) rows.

    Ranks come from md5 prefix buckets: counts per bucket give each one's offset, ranks inside are local. Strata are few
    classes, none null.
    """
    by = strata or []
    keyed = df.withColumn("_k", seeded(seed, id_col)).withColumn("_b", F.substring("_k", 1, 3))
    sizes = keyed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 buckets a stratum at most
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    total = F.broadcast(sizes.groupBy(*by).agg(F.sum("_n").alias("_total")))
    rank = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_k", id_col)) - 1 + F.col("_off")
    out = keyed.join(F.broadcast(offsets), [*by, "_b"]).withColumn("_rank", rank)
    out = out.join(total, by) if by else out.crossJoin(total)
    names, edge, split = list(ratios), F.lit(0), F
    for name in names[:-1]:
        edge = edge + F.floor(F.col("_total") * ratios[name])
        split = split.when(F.col("_rank") < edge, name)
    return out.withColumn("split", split.otherwise(names[-1])).drop("_k", "_b", "_n", "_off", "_rank", "_total")


def round_robin(df: DataFrame, strata: list[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows dealt in turn from the sorted strata, each in seeded order."""
    # a stratum's row beyond n can't be dealt: the window filter below keeps n a stratum before the last sort
    w = Window.partitionBy(*strata).orderBy(seeded(seed, id_col), id_col)
    ranked = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return ranked.orderBy("turn", *strata).limit(n)


def quota(df: DataFrame, source: str, order: str, allowed: list[str], rows: int) -> DataFrame:
    """Rows of the allowed sources up to balanced quotas: rows / sources each, the remainder to the first."""
    base, more = divmod(rows, len(allowed))
    limit = F
    for i, s in enumerate(allowed):
        limit = limit.when(F.col(source) == s, base + (i < more))
    w = Window.partitionBy(source).orderBy(order)
    # the constant bound lets each task keep so many rows a source before the shuffle
    ranked = df.where(F.col(source).isin(allowed)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= base + 1)
    return ranked.where(F.col("rank") <= limit.otherwise(0))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Batch and sheet row of each row in order; order is a dense unique number from 0."""
    return df.withColumns({"batch": F.floor(F.col(order) / size) + 1, "excel_row": F.col(order) % size + 2})


def leaks(df: DataFrame, content: Column, split: str) -> DataFrame:
    """Contents that stand in more than one split."""
    g = df.groupBy(F.md5(content).alias("hash")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.countDistinct(split).alias("k"))
    return g.where("k > 1").drop("k")
