"""Exact similarity self-joins of sets, and meeting places of contained texts.

Two sets of a Jaccard similarity t differ in at most d = (1 - t) / t of the smaller one's items. Dealt by hash into p parts,
they agree on p - d of them at least, so a set needs keys for no more than d + 1 of its parts: its rarest ones. What many
unrelated sets have in common, a part with one everyday item or none, comes last and is left out; a set with more than d
parts of its own meets nobody. Keys that do meet are held against a second bound before a pair is made: the parities
of both sets' items, dealt into many bits, differ in no more bits than the sets do in items.

Large sets of everyday items have most of their parts in common with some unrelated set, so keys make about as many pairs as there
are. Where a size class has few sets (FEW) they are not keyed: blocks of parities meet each other, by products of matrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop, keep_table

LARGEST = 2**31
KIND = 512  # more than there are size classes
FEW = 2**17  # sets under one class that meet in blocks
EACH = 4  # sets of a block that one of another meets before the others wait for components


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Parts:
    """Parts of sets by size: sets of one size class, or of two that follow each other, are dealt alike."""

    def __init__(self, threshold: float):
        self.t, edges = threshold, [1]
        while threshold < 1 and edges[-1] < LARGEST:
            edges.append(max(edges[-1] + 1, int(edges[-1] / threshold) + 1))
        self.edges = np.array(edges)

    def scheme(self, c: int) -> tuple[int, int]:
        """Greatest difference and number of parts for pairs whose smaller set is of class c.

        A few parts more than must agree leave room to skip frequent ones; small sets need more, as more of their parts are empty.
        Large parts are what unrelated sets of everyday items seldom have in common, so there are not many more.
        """
        if self.t >= 1:
            return 0, 1
        apart = int((self.edges[c + 1] - 1) * (1 - self.t) / self.t + 1e-9)
        return apart, 1 if not apart else 2 * (apart + 1) if apart <= 12 else int(1.1 * (apart + 1))

    def classes(self, n: int) -> list[int]:
        """Classes under which a set of n items meets others."""
        size = int(np.searchsorted(self.edges, n, "right")) - 1
        return [0] if self.t >= 1 else sorted({max(size - 1, 0), size})

    def keys(self, h: np.ndarray, c: int) -> np.ndarray:
        """A key for the content of each part of a set of distinct hashed items, empty ones too."""
        parts = self.scheme(c)[1]
        content = np.zeros(parts, np.uint64)
        np.add.at(content, (mixed(h, 7) % np.uint64(parts)).astype(np.int64), mixed(h))
        return mixed(content ^ mixed(np.arange(parts, dtype=np.uint64) + np.uint64(c << 40), 3))

    def parity(self, h: np.ndarray, c: int) -> np.ndarray:
        """Parities of the numbers of items dealt to some more bits than twice the greatest difference, as 64-bit words: sets with
        little in common differ in nearly half of them."""
        bits = 64 * (2 + int(2.5 * self.scheme(c)[0]) // 64)
        odd = np.bincount((mixed(h, 11) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The arrays of a list column as unsigned numbers."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for i, j in zip(ends[:-1], ends[1:]):
        yield flat[i:j].view(np.uint64)


def hashed_sets(df: DataFrame, id_col: str, text: Column, make, name: str = "s") -> DataFrame:
    """(id, s): make(text) -> unsigned 64-bit numbers, as an array of longs; null texts count as empty."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for b in batches:
            out = [make(t or "").view(np.int64) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, np.concatenate([*out, np.empty(0, np.int64)]))], names=["id", name])

    return df.select(F.col(id_col).alias("id"), text.alias("t")).mapInArrow(run, f"id {kind}, {name} array<long>")


def gram_hashes(text: str, n: int) -> np.ndarray:
    """A hash for each n characters of the text that follow each other, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(c) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + c[i : len(c) - n + 1 + i] + np.uint64(1)
    return mixed(h)


def gram_similarity(a: str, b: str, n: int = 4) -> float:
    """Jaccard similarity of the character n-gram sets; two without any are alike."""
    x, y = np.unique(gram_hashes(a, n)), np.unique(gram_hashes(b, n))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0


def char_grams(df: DataFrame, id_col: str, text: Column, n: int = 4) -> DataFrame:
    """(id, s): distinct hashed character n-grams; none for shorter texts."""
    return hashed_sets(df, id_col, text, lambda t: np.unique(gram_hashes(t, n)))


def fingerprints(text: str, least: int) -> np.ndarray:
    """Winnowing: the least gram hash of each stretch, so that texts with `least` characters in common share one."""
    n = max(1, least // 2)
    h, stretch = gram_hashes(text, n), least - n + 1
    if len(h) < stretch:
        return np.empty(0, np.uint64)
    width = 1
    while width < stretch:  # minima of stretches twice as long, the last time overlapping
        step = min(width, stretch - width)
        h = np.minimum(h[: len(h) - step], h[step:])
        width += step
    return np.unique(h)


def word_numbers(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct words between the spaces of each text as hashes, hashed together."""
    words = [[w for w in t.split(" ") if w] for t in texts]
    flat = pd.util.hash_array(np.array([w for ws in words for w in ws], dtype=object)) if any(words) else np.empty(0, np.uint64)
    ends = np.cumsum([0, *map(len, words)])
    for i, j in zip(ends[:-1], ends[1:]):
        yield np.unique(flat[i:j])


def sketches(rows: DataFrame, kinds: list[tuple[float, Callable[[list[str]], Iterable[np.ndarray]]]], keep_table) -> DataFrame:
    """(id, code, n, t, parity): a written table of the sets of the rows (id long, t) under each of their classes."""

    def sketch(batches):
        schemes = [Parts(t) for t, _ in kinds]
        for b in batches:
            found = [(i, KIND * kind + c, len(h), kinds[kind][0], schemes[kind].parity(h, c)) for i, kind, c, h in coded_sets(b, kinds)]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(types)], names=["id", "code", "n", "t", "parity"])

    return keep_table(rows.select("id", "t").mapInArrow(sketch, "id long, code int, n int, t double, parity array<long>"))


def coded_sets(b: pa.RecordBatch, kinds) -> Iterator[tuple]:
    """(id, kind, class, set) of a batch of (id, t)."""
    schemes, ids, texts = [Parts(t) for t, _ in kinds], b.column(0).to_pylist(), b.column(1).to_pylist()
    for at in range(0, len(ids), 256):
        for kind, (parts, (_, make)) in enumerate(zip(schemes, kinds)):
            for i, h in zip(ids[at : at + 256], make(texts[at : at + 256])):
                for c in parts.classes(len(h)) if len(h) else ():
                    yield i, kind, c, h


def packed_meetings(rows: DataFrame, sketched: DataFrame, kinds, codes: set[int], keep_table) -> DataFrame:
    """The meetings of rows (id long, t) under these codes, for one kind of sets or more: (threshold, texts -> sets of numbers).

    They are those of meetings(). Few parts meet others but all have to be counted,
    so they travel packed: 4 bytes of key each, by slices of the keys, and those that several sets have back by slices of
    the ids, with their numbers of sets. Neither sets nor keys are written.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forms = {"id": np.int64, "code": np.uint16, "part": np.uint32, "key": np.uint64, "df": np.uint32}

    def packed(*names):
        return "slice int, " + ", ".join(f"{n} binary" for n in names)

    def pack(to, **arrays):
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(slices + 1))
        used = np.flatnonzero(ends[1:] > ends[:-1])
        moved = [a[order].astype(forms[n], copy=False) for n, a in arrays.items()]
        cut = [pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in used], pa.binary()) for x in moved]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *cut], names=["slice", *arrays])

    def unpack(batches, *names):
        got = [[np.empty(0, forms[n])] for n in names]
        for b in batches:
            for k, n in enumerate(names):
                got[k] += [np.frombuffer(x, forms[n]) for x in b.column(n).to_pylist()]
        return [np.concatenate(g) for g in got]

    def deal(batches):
        schemes, found, held = [Parts(t) for t, _ in kinds], [], 0

        def flushed():
            keys, count = np.concatenate([f[2] for f in found]), [len(f[2]) for f in found]
            ids, codes = (np.repeat(np.array([f[k] for f in found], form), count) for k, form in ((0, np.int64), (1, np.uint16)))
            return pack(((keys >> np.uint64(32)) % np.uint64(slices)).astype(np.int64), id=ids, code=codes, part=keys & np.uint64(2**32 - 1))

        for b in batches:
            for i, kind, c, h in coded_sets(b, kinds):
                if KIND * kind + c not in codes:
                    continue
                found.append((i, KIND * kind + c, schemes[kind].keys(h, c) ^ mixed(np.array([kind], np.uint64), 5)))
                held += len(found[-1][2])
                if held > 1_000_000:
                    yield flushed()
                    found, held = [], 0
        if found:
            yield flushed()

    def shared(batches):
        batches = iter(batches)
        slice_, rest = -1, []
        for b in batches:  # a partition is a slice
            if len(b):
                slice_ = b.column(0)[0].as_py()
            rest.append(b)
        ids, codes, part = unpack(rest, "id", "code", "part")
        order = np.argsort(part, kind="stable")
        new = np.flatnonzero(np.r_[True, part[order[1:]] != part[order[:-1]]]) if len(part) else np.empty(0, np.int64)
        df = np.diff(np.r_[new, len(part)])
        df = np.repeat(df, df)
        at, df = order[df > 1], df[df > 1]
        key = part[at].astype(np.uint64) | np.uint64(max(slice_, 0) << 32)
        yield pack((ids[at].view(np.uint64) % np.uint64(slices)).astype(np.int64), id=ids[at], code=codes[at], key=key, df=df)

    def rarest(batches):
        ids, codes, key, df = unpack(batches, "id", "code", "key", "df")
        order = np.lexsort((key, df, codes, ids))
        ids, codes, key = ids[order], codes[order], key[order]
        new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (codes[1:] != codes[:-1])]) if len(ids) else np.empty(0, np.int64)
        n = np.diff(np.r_[new, len(ids)])
        schemes, room = [Parts(t) for t, _ in kinds], np.zeros(KIND * len(kinds), np.int64)
        for code in np.unique(codes).tolist():
            apart, parts = schemes[code // KIND].scheme(code % KIND)
            room[code] = apart + 1 - parts
        keep = np.arange(len(ids)) - np.repeat(new, n) < np.repeat(room[codes[new]] + n, n)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(ids[keep]), pa.array(codes[keep].astype(np.int32))], names=["key", "id", "code"])

    rows = rows.select("id", "t")
    by_key = rows.mapInArrow(deal, packed("id", "code", "part")).repartitionById(slices, F.col("slice"))
    by_id = by_key.mapInArrow(shared, packed("id", "code", "key", "df")).repartitionById(slices, F.col("slice"))
    rare = by_id.mapInArrow(rarest, "key long, id long, code int")
    met = rare.join(sketched, ["id", "code"])
    return keep_table(met.select("key", "id", "n", "t", "parity"))


def meetings(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, id, n, t, parity): a written table of the rarest keys of the sets (id, s), without those that only one set has."""
    sets = sets.select("id", "s").where("size(s) > 0")
    if dict(sets.dtypes)["s"] != "array<bigint>":
        sets = sets.withColumn("s", F.transform("s", lambda x: F.xxhash64(x)))
    kind = dict(sets.dtypes)["id"]

    def key(batches):
        parts = Parts(threshold)
        for b in batches:
            found = [(i, c, *parts.scheme(c), parts.keys(h, c)) for i, h in enumerate(lists(b.column(1))) for c in parts.classes(len(h))]
            count = np.array([len(f[-1]) for f in found], np.int64)
            numbers = [pa.array(np.repeat(np.array([f[k] for f in found], np.int32), count)) for k in (1, 2, 3)]
            at = pa.array(np.repeat(np.array([f[0] for f in found], np.int64), count))
            flat = pa.array(np.concatenate([*(f[-1] for f in found), np.empty(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *numbers, flat], names=["id", "c", "apart", "parts", "key"])

    def sketch(batches):
        parts = Parts(threshold)
        for b in batches:
            found = [(i, c, len(h), parts.parity(h, c)) for i, h in enumerate(lists(b.column(1))) for c in parts.classes(len(h))]
            ends = np.cumsum([0, *(len(f[-1]) for f in found)]).astype(np.int32)
            numbers = [pa.array(np.array([f[k] for f in found], np.int32)) for k in (1, 2)]
            bits = pa.ListArray.from_arrays(ends, np.concatenate([*(f[-1] for f in found), np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([f[0] for f in found], pa.int64())), *numbers, bits], names=["id", "c", "n", "parity"])

    posts = keep_table(sets.mapInArrow(key, f"id {kind}, c int, apart int, parts int, key long"))
    often = keep_table(posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    own = Window.partitionBy("id", "c")
    room = F.col("apart") + 1 - (F.col("parts") - F.count("*").over(own))
    rare = posts.join(often, "key").withColumn("room", room).where("room > 0")
    rare = rare.withColumn("rank", F.row_number().over(own.orderBy("df", "key"))).where("rank <= room").select("key", "id", "c")
    rare = keep_table(rare)
    some = sets.join(rare.select("id").distinct(), "id", "left_semi").mapInArrow(sketch, f"id {kind}, c int, n int, parity array<long>")
    met = keep_table(rare.join(some, ["id", "c"]).select("key", "id", "n", F.lit(float(threshold)).alias("t"), "parity"))
    drop(posts, often, rare)
    return met


def may_be_alike(a: str, b: str) -> Column:
    """Whether sizes and parities of the meetings a and b leave a similarity of t possible."""
    na, nb, t = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.t")
    differ = F.aggregate(F.zip_with(f"{a}.parity", f"{b}.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return (na >= t * nb) & (nb >= t * na) & (differ <= (na + nb) * (1 - t) / (1 + t) + 1e-9)


def candidates(met: DataFrame) -> DataFrame:
    """(a, b), a < b, distinct: all pairs of the meetings that may be alike."""
    both = met.alias("x").join(met.alias("y"), "key").where(F.col("x.id") < F.col("y.id")).where(may_be_alike("x", "y"))
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def parity_blocks(sketched: DataFrame, keep_table) -> DataFrame:
    """A written table of the sketches (id, code, n, t, parity, grp, asked), by code and size: up to some thousands in a row,
    as one run of longs, see block_arrays()."""

    def run(batches):
        for b in batches:
            code, words = b.column("code").to_numpy(), b.column("parity").value_lengths().to_numpy()
            for c in np.unique(code).tolist():
                at, end = np.searchsorted(code, [c, c + 1]).tolist()
                step = int(max(1, min(2048, 2**16 // words[at])))
                for i in range(at, end, step):
                    x = b.slice(i, min(step, end - i))
                    n = x.column("n").to_numpy().astype(np.int64)
                    ids, grp, asked = (np.asarray(x.column(k).to_numpy(zero_copy_only=False), np.int64) for k in ("id", "grp", "asked"))
                    sets = np.concatenate([ids, n, grp - ids, asked, x.column("parity").flatten().to_numpy()])
                    row = {"code": c, "t": x.column("t")[0].as_py(), "least": int(n[0]), "most": int(n[-1]), "any": bool(asked.any()), "many": len(n), "sets": sets.tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("code", pa.int32()), ("t", pa.float64()), ("least", pa.int64()), ("most", pa.int64()), ("any", pa.bool_()), ("many", pa.int64()), ("sets", pa.binary())])
    sorted_ = sketched.select("id", "code", "n", "t", "parity", "grp", "asked").repartitionByRange("code", "n", "id").sortWithinPartitions("code", "n", "id")
    packed = sorted_.mapInArrow(run, "code int, t double, least long, most long, any boolean, many long, sets binary")
    return keep_table(packed.withColumn("block", F.monotonically_increasing_id()).repartition(int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def block_arrays(row: dict) -> tuple[np.ndarray, ...]:
    """ids, sizes, groups, asked or not, parities of a block."""
    x, n = np.frombuffer(row["sets"], np.int64), row["many"]
    return x[:n], x[n : 2 * n], x[:n] + x[2 * n : 3 * n], x[3 * n : 4 * n] > 0, x[4 * n :]


def unpacked(blocks: DataFrame) -> DataFrame:
    """(id, code, n, t, parity) of blocks."""

    def run(batches):
        for row in (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(len(b))):
            ids, n, _, _, parity = block_arrays(row)
            ends = np.arange(len(ids) + 1, dtype=np.int32) * (len(parity) // len(ids))
            fixed = pa.array(np.full(len(ids), row["code"], np.int32)), pa.array(n.astype(np.int32)), pa.array(np.full(len(ids), row["t"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *fixed, pa.ListArray.from_arrays(ends, parity)], names=["id", "code", "n", "t", "parity"])

    return blocks.mapInArrow(run, "id long, code int, n int, t double, parity array<long>")


def block_candidates(blocks: DataFrame, each: int | None = None) -> DataFrame:
    """(a, b, late, more): pairs a < b of different groups that may be alike; late is the one asked, which the larger size has.

    With `each`, no more of them for a set and a block than so many, and whether there are more.
    """

    def run(batches):
        for b in batches:
            found = [np.empty((0, 4), np.int64)]
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(len(b))):
                (ia, na, ga, _, bits_a), (ib, nb, gb, asked, bits_b) = block_arrays(row["x"]), block_arrays(row["y"])
                t, c, asked = row["x"]["t"], row["x"]["code"] % KIND, np.flatnonzero(asked)
                edges = Parts(t).edges
                signs = lambda parity, n: 1 - 2 * np.unpackbits(parity.view(np.uint8).reshape(n, -1), axis=1).astype(np.float32)
                sa, sb = signs(bits_a, len(ia)), signs(bits_b, len(ib))[asked]
                share = 2 * (1 - t) / (1 + t)  # equal signs less unequal ones: at least bits - share * (na + nb)
                room = (share * nb[asked] * (1 + 1e-6) - sa.shape[1] + 0.5).astype(np.float32)
                met = []
                for i in range(0, len(ia), 512):
                    agree = sa[i : i + 512] @ sb.T
                    agree += room
                    agree += (share * na[i : i + 512] * (1 + 1e-6)).astype(np.float32)[:, None]
                    p, q = np.nonzero(agree >= 0)
                    met.append((p + i, asked[q]))
                p, q = (np.concatenate(m) for m in zip(*met))
                ok = (na[p] >= t * nb[q]) & (nb[q] >= t * na[p]) & (ga[p] != gb[q])
                if t < 1:  # else all are of one class
                    ok &= np.minimum(na[p], nb[q]) < edges[c + 1]
                if row["x"]["block"] == row["y"]["block"]:
                    ok &= p < q
                p, q = p[ok], q[ok]
                more = np.zeros(len(q), np.int64)
                if each is not None:
                    order = np.lexsort((ia[p], q))
                    p, q = p[order], q[order]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    more = (np.bincount(q, minlength=len(ib))[q] > each).astype(np.int64)
                    p, q, more = p[rank < each], q[rank < each], more[rank < each]
                found.append(np.stack([np.minimum(ia[p], ib[q]), np.maximum(ia[p], ib[q]), ib[q], more], 1))
            x = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(3)), pa.array(x[:, 3] > 0)], names=["a", "b", "late", "more"])

    side = lambda name: blocks.select(F.struct(*blocks.columns).alias(name))
    # not by equality of codes: few codes have most blocks, which all tasks should share
    near = F.col("x.code").between(F.col("y.code"), F.col("y.code")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.most") >= F.col("x.t") * F.col("y.least")) & F.col("y.any")
    return side("x").join(side("y"), near).mapInArrow(run, "a long, b long, late long, more boolean")


class Meetings:
    """Pairs of sets that may be alike, of rows (id long, t) and kinds (threshold, texts -> sets of numbers). Reads rows once, or three
    times where classes have more than `few` sets."""

    def __init__(self, rows: DataFrame, kinds: list[tuple[float, Callable[[list[str]], Iterable[np.ndarray]]]], keep_table, few: int = FEW):
        self.keep = keep_table
        self.spark, sketched = rows.sparkSession, sketches(rows, kinds, keep_table)
        counts = {r["code"]: r["n"] for r in sketched.groupBy("code").agg(F.count("*").alias("n")).collect()}  # a row for each size class
        many = {c for c, n in counts.items() if n > few}
        few_of = sketched.where(~F.col("code").isin(*many)) if many else sketched
        self.blocks = parity_blocks(few_of.withColumns({"grp": F.col("id"), "asked": F.lit(True)}), keep_table) if len(many) < len(counts) else None
        self.met = packed_meetings(rows, sketched, kinds, many, keep_table) if many else None
        drop(sketched)

    def together(self, *found: DataFrame | None) -> DataFrame:
        """The distinct pairs (a, b) of what is found, as a written table."""
        found = [f.select("a", "b") for f in found if f is not None]
        none = self.spark.createDataFrame([], "a long, b long")
        return self.keep(reduce(DataFrame.union, found, none).distinct())

    def pairs(self) -> DataFrame:
        """(a, b), a < b, distinct: all of them."""
        return self.together(None if self.blocks is None else block_candidates(self.blocks), None if self.met is None else candidates(self.met))

    def spanning(self, accept, components) -> DataFrame:
        """(a, b): links accepted of the pairs, enough of them to reach all that all accepted pairs would reach.

        Each key's smallest set meets the others first, and each set EACH of a block, which is linear. Only where a key then
        still holds several components do their members meet across them, and sets that have met more those of other
        components: a family of copies of any size is linked through some of its own.
        accept(pairs) gives the pairs (a, b) that are links.
        """
        met, first, found = self.met, None, None
        if met is not None:
            lead = met.groupBy("key").agg(F.min(F.struct("id", "n", "t", "parity")).alias("lead")).select("key", "lead.*")
            first = met.alias("y").join(lead.alias("x"), "key").where(F.col("x.id") < F.col("y.id")).where(may_be_alike("x", "y"))
            first = first.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        if self.blocks is not None:
            found = self.keep(block_candidates(self.blocks, EACH))
        links = self.keep(accept(self.together(first, found)).select("a", "b"))
        of = self.keep(components(links).select(F.col("node").alias("id"), F.col("component").alias("grp")))
        across = again = None
        if met is not None:
            known = self.keep(met.join(of, "id", "left").withColumn("component", F.coalesce("grp", "id")).drop("grp"))
            split = known.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
            rest = self.keep(known.join(split, "key", "left_semi"))
            across = rest.alias("x").join(rest.alias("y"), "key").where((F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))).where(may_be_alike("x", "y"))
            across = across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        if found is not None:
            crowded = self.keep(found.where("more").select(F.col("late").alias("id")).distinct())
            if not crowded.isEmpty():
                sketched = unpacked(self.blocks).join(of, "id", "left").join(crowded.withColumn("asked", F.lit(True)), "id", "left")
                sketched = sketched.withColumns({"grp": F.coalesce("grp", "id"), "asked": F.coalesce("asked", F.lit(False))})
                again = block_candidates(parity_blocks(sketched, self.keep))
        if across is None and again is None:
            return links
        more = self.keep(accept(self.together(across, again)).select("a", "b"))
        if met is not None:
            drop(known, rest)
        return links.union(more)


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of the sets (id, s) with a Jaccard similarity of the threshold or more: exact.

    Give it one row for each class of equal sets: a group of copies would make the square of its size.
    """
    s = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"))
    both = candidates(meetings(sets, threshold)).join(s("a"), "a").join(s("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity"))
    return both.where(F.col("similarity") >= threshold)


def contained(big: DataFrame, big_id: str, big_text: Column, small: DataFrame, small_id: str, small_text: Column, least: int = 30) -> DataFrame:
    """(big_id, small_id) where the small text stands in the big one, both of `least` characters: exact.

    A contained text brings all its fingerprints, so the two meet on the small one's rarest.
    """
    l = big.select(F.col(big_id).alias("big"), big_text.alias("bt")).where(F.length("bt") >= least)
    r = small.select(F.col(small_id).alias("small"), small_text.alias("st")).where(F.length("st") >= least)
    prints = lambda df, i, t: hashed_sets(df, i, F.col(t), lambda x: fingerprints(x, least)).select(F.col("id").alias(i), F.explode("s").alias("mark"))
    at, mine = prints(l, "big", "bt"), prints(r, "small", "st")
    often = at.groupBy("mark").agg(F.count("*").alias("df"))
    key = mine.join(often, "mark", "left").groupBy("small").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "mark")).alias("k")).where("k.df > 0").select("small", F.col("k.mark").alias("mark"))
    hit = key.join(at, "mark").select("big", "small").join(l, "big").join(r, "small").where(F.col("bt").contains(F.col("st")))
    return hit.select(F.col("big").alias(big_id), F.col("small").alias(small_id))


def blocks(sets: DataFrame) -> DataFrame:
    """The sets (id, s) of longs that have an id and items, some thousands in a row: (ids, sizes, items)."""
    kind = dict(sets.dtypes)["id"]

    def run(batches):
        held = []

        def packed():
            ids, flat = pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1).flatten() for b in held])
            sizes = np.concatenate([b.column(1).value_lengths().to_numpy() for b in held]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sizes.tobytes()]), pa.array([flat.to_numpy().tobytes()])], names=["ids", "sizes", "items"])

        for b in batches:
            b = b.filter(pc.and_(b.column(0).is_valid(), pc.fill_null(pc.greater(b.column(1).value_lengths(), 0), False)))
            held += [b] if len(b) else []
            if sum(map(len, held)) >= 16_384 or sum(len(b.column(1).values) for b in held) >= 2**20:
                yield packed()
                held = []
        if held:
            yield packed()

    return sets.mapInArrow(run, f"ids array<{kind}>, sizes binary, items binary")


class Nearest:
    """The k sets of the highest similarity above `least` that each query of a block has met."""

    EVERYDAY = 128  # the queries' most frequent items: nearly all pairs have some in common, so they are counted by a product of matrices
    PAIRS = 2**22  # at a time

    def __init__(self, ids: pa.Array, n: np.ndarray, items: np.ndarray, k: int, least: float):
        self.ids, self.n, self.k, self.least = ids, n, k, least
        self.known, code = np.unique(items, return_inverse=True)
        self.place = np.argsort(np.argsort(-np.bincount(code), kind="stable"))
        q, place = np.repeat(np.arange(len(n)), n), self.place[code]
        self.often = self.matrix(len(n), q, place)
        order = np.argsort(place, kind="stable")
        self.postings, self.first = q[order], np.searchsorted(place[order], np.arange(len(self.known) + 1))
        self.bar, self.step, self.best = np.full(len(n), self.share(least)), 64, None

    @staticmethod
    def share(score):
        """What two sets of this similarity have in common of the sum of their sizes, at least."""
        return score / (1 + score) * (1 - 1e-9)

    def matrix(self, rows: int, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        x = np.zeros((rows, self.EVERYDAY), np.float32)
        x[at[place < self.EVERYDAY], place[place < self.EVERYDAY]] = 1
        return x

    def meet(self, ids: pa.Array, n: np.ndarray, items: np.ndarray) -> None:
        """All pairs of the block's queries and these sets, a few sets first: the more is found, the fewer pairs are of use."""
        at = np.minimum(np.searchsorted(self.known, items), len(self.known) - 1)
        asked = self.known[at] == items
        owner, place = np.repeat(np.arange(len(n)), n)[asked], self.place[at[asked]]
        start = 0
        while start < len(n):
            end = min(start + self.step, len(n))
            i, j = np.searchsorted(owner, [start, end])
            common = self.common(end - start, owner[i:j] - start, place[i:j])
            h, q = np.nonzero(common >= np.add.outer(n[start:end], self.n) * self.bar)
            both = common[h, q].astype(np.int64)
            self.add(q, both / (n[start + h] + self.n[q] - both), ids.take(pa.array(start + h)))
            start, self.step = end, max(1, min(2 * self.step, self.PAIRS // len(self.n)))

    def common(self, rows: int, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number of items that each of these sets and each query have in common."""
        product = self.matrix(rows, owner, place) @ self.often.T
        owner, place = owner[place >= self.EVERYDAY], place[place >= self.EVERYDAY]
        count = self.first[place + 1] - self.first[place]
        hit = np.repeat(self.first[place] - np.cumsum(count) + count, count) + np.arange(count.sum())
        product += np.bincount(np.repeat(owner * len(self.n), count) + self.postings[hit], minlength=product.size).reshape(product.shape)
        return product

    def add(self, q: np.ndarray, score: np.ndarray, h: pa.Array) -> None:
        new = pa.table({"q": q, "score": score, "h": h})
        new = new.filter(pc.and_(pa.array(score > self.least), pc.not_equal(self.ids.take(pa.array(q)), h)))
        best = pa.concat_tables([new] if self.best is None else [self.best, new])
        best = best.sort_by([("q", "ascending"), ("score", "descending"), ("h", "ascending")])
        q, score = best["q"].to_numpy(), best["score"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.best = best.filter(pa.array(rank < self.k))
        self.bar[q[rank == self.k - 1]] = self.share(score[rank == self.k - 1])


def top_similar(queries: DataFrame, history: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """(q, h, score, rank): for each query set the k sets of the history of the highest Jaccard similarity above `least`, other
    ids only, ties to the smaller id. Both are (id, s), s an array of distinct items.

    Blocks of the history meet blocks of queries where they are read, and only the k best of each task travel: texts have
    everyday items in common with most others, so that candidates would be most pairs of a query and a set. Exact.
    """
    kind, asking = dict(history.dtypes)["id"], dict(queries.dtypes)["id"]
    hashed = lambda x: x.where("id is not null").select("id", F.transform("s", lambda v: F.xxhash64(v)).alias("s"))
    rows = keep_table(hashed(queries))
    # a task holds the queries of a part: 128 MB of items and matrices at most
    parts = 1 + (rows.where("size(s) > 0").agg(F.sum(F.size("s") + Nearest.EVERYDAY // 2)).first()[0] or 0) // 2**24
    asked = keep_table(blocks(rows.coalesce(parts)).select(F.monotonically_increasing_id().alias("block"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "sizes", "items"))))
    drop(rows)

    def nearest(batches):
        found = {}
        for b in batches:
            numbers = lambda name, i: np.frombuffer(b.column(name)[i].as_py(), np.int64)
            for i, block in enumerate(b.column("block").to_pylist()):
                if block not in found:
                    found[block] = Nearest(b.column("q_ids")[i].values, numbers("q_sizes", i), numbers("q_items", i), k, least)
                found[block].meet(b.column("ids")[i].values, numbers("sizes", i), numbers("items", i))
        for x in found.values():
            yield from x.best.select(["h", "score"]).add_column(0, "q", x.ids.take(x.best["q"])).to_batches()

    sets = hashed(history)  # shuffled only if it comes in fewer tasks than there are cores, as from a small file
    few = history.rdd.getNumPartitions() < history.sparkSession.sparkContext.defaultParallelism
    met = blocks(sets.repartition("id") if few else sets).crossJoin(asked.coalesce(parts)).mapInArrow(nearest, f"q {asking}, h {kind}, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "h")
    top = keep_table(met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    drop(asked)
    return top
