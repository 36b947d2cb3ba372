"""Benchmark decontamination through a positional inverted index, in DataFrame functions only.

Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. A window is WINDOW words in
a row of an item; an item of fewer words is one window. Windows of equal words are one.

1. Frequencies: how often each of the benchmark's terms stands in all texts.
2. Postings (term, text, position) of the ANCHORS rarest terms of any window. A text is named by two hashes, so copies
   share their postings.
3. Lists are intersected with their offsets taken off, from each window's rarest term on: what is left of the first
   list is looked up in the second, and so on; what all lists share is a candidate (text, start, window).
4. The words at a candidate's start are compared with its window, which makes the match exact. For proximity matches the
   lists are intersected with a tolerance, and the words around a candidate are compared with the window's terms.

Words that aren't among the terms meet only a join that drops them. Benchmark tables are broadcast up to a counted bound
and shuffled beyond, where AQE splits frequent terms; so are candidates. A passage in a third of all texts gives a
row for each text that differs, not for each pair.

Null and empty texts and items have no words, and items without words no window. A null item id is an item without a
name: its windows hit, but it isn't listed. Repeated items count once, repeated documents get equal rows. Empty tables
give no rows (documents) or no hits (items). Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import drop, materialize

#: Fixed value: what stands between words, before A-Z become a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, ANCHORS = 10, 2
#: Rows of a benchmark table that may be broadcast, and of candidates.
BROADCAST_ROWS, BROADCAST_CANDIDATES = 500_000, 250_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """A-Z to a-z and nothing else; the quick function is right where all characters are ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def with_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the words of a text, as they are written: what splitting leaves, without an empty first or last piece.

    Give them to an outer explode: for an inner one a filter is inferred that splits each text several times more.
    """
    cut = df.withColumn(name, F.split(F.coalesce(text, F.lit("")), BETWEEN))
    first = (F.get(name, F.lit(0)) == "").cast("int")
    last = ((F.get(name, F.size(name) - 1) == "") & (F.size(name) > 1)).cast("int")
    return cut.withColumn(name, F.slice(name, first + 1, F.size(name) - first - last))


def term(word: Column) -> Column:
    """Terms are compared by hash until a candidate's words are: two that share one can add a candidate, never lose a match."""
    return F.xxhash64(lowered(word))


def hashes(text: str) -> list[Column]:
    """Two independent hashes that name a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t0"), F.xxhash64(F.lit("second"), text).alias("t1")]


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """df, a written table, with a broadcast hint if it has no more rows than the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def windows_of(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """window (digest of its words), length, terms, item_set (digest of the ids), item_ids (sorted strings)."""
    named = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("t"))
    split = with_words(named, "t", "w").select("item", F.transform("w", lowered).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    each = split.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("terms"))
    ids = F.array_sort(F.collect_set("item"))
    each = each.groupBy("terms").agg(ids.alias("item_ids"))
    return each.select(
        F.md5(F.array_join("terms", " ")).alias("window"), F.size("terms").alias("length"), "terms", F.md5(F.array_join("item_ids", ",")).alias("item_set"), "item_ids"
    )


def frequencies(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """term, n: how often each of the terms stands in the texts; terms that don't are absent."""
    each = with_words(docs.select(F.col(text_col).alias("t")), "t", "w").select(F.explode_outer("w").alias("w")).where("w is not null").select(term(F.col("w")).alias("term"))
    return each.join(bounded(terms, BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """term, t0, t1, position (from 1): where each of the terms stands in each distinct text."""
    named = with_words(docs.select(*hashes(text_col), F.col(text_col).alias("t")), "t", "w")
    each = named.select("t0", "t1", F.posexplode_outer("w").alias("position", "w")).where("w is not null").select(term(F.col("w")).alias("term"), "t0", "t1", (F.col("position") + 1).alias("position"))
    return each.join(bounded(terms, BROADCAST_ROWS), "term").distinct()


def anchored(windows: DataFrame, freq: DataFrame, anchors: int) -> DataFrame:
    """window, length and, rarest first and up to `anchors` of each: rarest (n, offset, term) and scarce (n, term), in which
    a term that stands twice is one. Windows with a term that no text has are left out."""
    each = windows.select("window", "length", F.posexplode(F.transform("terms", lambda t: F.xxhash64(t))).alias("offset", "term")).join(freq, "term")
    each = each.groupBy("window", "length").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("all"))
    scarce = F.array_distinct(F.transform("all", lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term"))))
    return each.where(F.size("all") == F.col("length")).select("window", "length", F.slice("all", 1, anchors).alias("rarest"), F.slice(scarce, 1, anchors).alias("scarce"))


class Index:
    """Windows of the items and postings of their rarest terms in docs, as written tables."""

    def __init__(self, docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, size: int):
        self.windows = materialize(windows_of(items, item_col, item_text_col, size), "windows")
        terms = materialize(self.windows.select(F.explode(F.transform("terms", lambda t: F.xxhash64(t))).alias("term")).distinct(), "terms")
        freq = materialize(frequencies(docs, terms, text_col), "frequencies")
        self.rarest = materialize(anchored(self.windows, freq, ANCHORS), "rarest")
        wanted = materialize(self.rarest.select(F.explode(F.concat("rarest.term", "scarce.term")).alias("term")).distinct(), "wanted")
        self.postings = materialize(postings(docs, wanted, text_col), "postings")

    def anchor(self, column: str, k: int) -> DataFrame:
        x = F.get(F.col(column), k)
        fields = [x["offset"].alias("offset")] if column == "rarest" else []
        return bounded(materialize(self.rarest.select("window", x["term"].alias("term"), *fields), "anchor"), BROADCAST_ROWS)

    def in_a_row(self) -> DataFrame:
        """t0, t1, start, window: where the lists of all of a window's rarest terms meet, their offsets taken off."""
        found = self.postings.join(self.anchor("rarest", 0), "term").select("t0", "t1", (F.col("position") - F.col("offset")).alias("start"), "window").where("start > 0")
        for k in range(1, ANCHORS):
            found = found.join(self.anchor("rarest", k), "window")
            ended = found.where("term is null").select("t0", "t1", "start", "window")
            sought = found.where("term is not null").withColumn("position", F.col("start") + F.col("offset"))
            met = sought.join(self.postings, ["term", "t0", "t1", "position"]).select("t0", "t1", "start", "window")
            found = materialize(met.unionByName(ended), "candidates")
        return found

    def nearby(self, within: int) -> DataFrame:
        """t0, t1, start, window: where a window's rarest term stands with the next rarest ones less than `within` words away.

        Positions meet by blocks of `within` words, so a term that fills a text meets its neighbours only.
        """
        block = lambda x: F.floor(x / within).cast("int")
        lists = self.postings.select("term", "t0", "t1", F.col("position").alias("other"), block(F.col("position")).alias("block"))
        found = self.postings.join(self.anchor("scarce", 0), "term").select("t0", "t1", F.col("position").alias("start"), "window")
        for k in range(1, ANCHORS):
            found = found.join(self.anchor("scarce", k), "window")
            ended = found.where("term is null").select("t0", "t1", "start", "window")
            here = block(F.col("start"))
            sought = found.where("term is not null").withColumn("block", F.explode(F.array(here - 1, here, here + 1)))
            met = sought.join(lists, ["term", "t0", "t1", "block"]).where(F.abs(F.col("start") - F.col("other")) < within)
            found = materialize(met.select("t0", "t1", "start", "window").distinct().unionByName(ended), "candidates")
        return found

    def attached(self, docs: DataFrame, text_col: str, found: DataFrame, compared: str, check) -> DataFrame:
        """docs with t0, t1, n_words and matches: (start, length, item_set) of the candidates that check(words, candidate) gives a
        start. compared: what check reads of a window. Equal matches stand side by side."""
        named = found.join(bounded(self.windows.select("window", "length", "item_set", F.col(compared).alias("compared")), BROADCAST_ROWS), "window")
        per_text = named.groupBy("t0", "t1").agg(F.array_sort(F.collect_set(F.struct("start", "length", "item_set", "compared"))).alias("_found"))
        few = found.count() <= BROADCAST_CANDIDATES
        per_text = materialize(per_text, "found")
        made = ["t0", "t1", "n_words", "matches"]
        rows = with_words(docs.select(*(c for c in docs.columns if c not in made), *hashes(text_col)), text_col, "_w")
        held = rows.join(F.broadcast(per_text) if few else per_text, ["t0", "t1"], "left")
        at = F.transform("_found", lambda m: F.struct(check(F.col("_w"), m).alias("start"), m["length"].alias("length"), m["item_set"].alias("item_set")))
        kind = "array<struct<start: int, length: int, item_set: string>>"
        matches = F.array_sort(F.filter(at, lambda m: m["start"].isNotNull())).cast(kind)
        return held.withColumns({"n_words": F.size("_w").cast("long"), "matches": F.coalesce(matches, F.array().cast(kind))}).drop("_w", "_found")


def phrases(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(docs with t0, t1, n_words, matches; windows): the (start, length, item_set) of all windows that stand in a text, by start.

    start counts words from 1. windows names each item_set's items. docs keeps its other columns.
    """
    index = Index(docs, items, text_col, item_col, item_text_col, window)
    there = lambda w, m: F.md5(F.array_join(F.transform(F.slice(w, m["start"], m["length"]), lowered), " ")) == m["compared"]
    out = index.attached(docs, text_col, index.in_a_row(), "window", lambda w, m: F.when(there(w, m), m["start"]))
    drop(index.postings)
    return out, index.windows


def proximity(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, within: int = 2 * WINDOW
) -> tuple[DataFrame, DataFrame]:
    """As phrases, for windows whose terms all stand, in any order, among `within` words in a row that hold a place of the
    window's rarest term: matches have the first such start for each place, and length is `within`."""
    index = Index(docs, items, text_col, item_col, item_text_col, window)

    def first(w, m):
        starts = F.sequence(F.greatest(F.lit(1), m["start"] - (within - 1)), m["start"])
        holds = lambda s: F.size(F.array_except(m["compared"], F.transform(F.slice(w, s, within), lowered))) == 0
        return F.get(F.filter(starts, holds), 0)

    out = index.attached(docs, text_col, index.nearby(within), "terms", first)
    drop(index.postings)
    once = F.filter("matches", lambda m, i: (i == 0) | (m != F.get(F.col("matches"), i - 1)))
    return out.withColumn("matches", F.transform(once, lambda m: m.withField("length", F.lit(within)))), index.windows


def covered(matches: str) -> Column:
    """Number of words inside any match; matches are sorted by start, so one pass adds what each has beyond those before."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc, m):
        end = m["start"] + m["length"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(m["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(matches, zero, add, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """id, n_words, n_hit, items (sorted ids as strings), contaminated. Texts that match the same sets of items find their union once."""
    spark = docs.sparkSession
    found, windows = phrases(docs.select(id_col, F.col(text_col).alias("_text")), items, "_text", **names)
    sets = F.array_sort(F.array_distinct("matches.item_set"))
    rows = materialize(found.select(F.col(id_col), "n_words", covered("matches").alias("n_hit"), sets.alias("sets"), F.md5(F.array_join(sets, ",")).alias("combined")), "hits")
    named = windows.select("item_set", "item_ids").dropDuplicates(["item_set"])
    each = rows.where("size(sets) > 0").dropDuplicates(["combined"]).select("combined", F.explode("sets").alias("item_set"))
    union = each.join(named, "item_set").select("combined", F.explode("item_ids").alias("item")).groupBy("combined").agg(F.array_sort(F.collect_set("item")).alias("items"))
    union = materialize(union, "unions")
    out = rows.join(bounded(union, BROADCAST_ROWS // 10), "combined", "left")
    return out.select(id_col, "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.col("n_hit") > 0).alias("contaminated"))
