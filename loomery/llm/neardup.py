"""Near-duplicate documents by HyperMinHash registers, banding, corrected estimates and exact verification.

Words are runs of bytes other than space and 09-0D, A-Z lower-cased. A document's set holds its distinct k-word
shingles as 64-bit hashes; with fewer words the whole sequence is one shingle; without words the set is empty and
linked with nothing. Documents with equal sets form a class, and only one member a class (the smallest id) goes on.

Rows that repeat a doc_id count as one document, linked through any of its texts. Null texts are empty. Rows with a
null doc_id are linked with nothing and keep a null component. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .workspace import BROADCAST_IDS, batches_of, drop, keep_ids, materialize, small_batches, tidy

REGISTERS, BANDS, MANTISSA = 128, 32, 10
#: Similarity as a fraction NUM / DEN.
NUM, DEN = 75, 100
#: 5 standard deviations (0.038 each) below the threshold: estimates under this are not verified.
LEAST_ESTIMATE = 0.55
#: Pairs of one right member that a task joins: a pivot of many pairs is copied and dealt to several.
SPREAD = 256
#: Rows, and their shingles, that meet each other in one step of the exact way through unresolved buckets.
BLOCK, BLOCK_SHINGLES = 128, 100_000


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, k)
    h = np.full(n - size + 1, 0x9E3779B97F4A7C15 + size, np.uint64)
    for i in range(size):
        h = (h ^ w[i : n - size + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def probe_order(registers: int) -> np.ndarray:
    """For each register, the order in which it looks for a filled one to copy."""
    rng = np.random.default_rng(7)
    return np.array([rng.permutation(registers) for _ in range(registers)])


def hyperminhash(h: np.ndarray, registers: int, mantissa: int, probes: np.ndarray) -> np.ndarray:
    """A register a bucket (the hash's top bits): leading zeros of the bucket's least rest, then mantissa bits after its first 1.

    Empty buckets copy a filled one, in an order of their own that is the same for all documents, so that small
    sets also agree register by register with the probability of their similarity.
    """
    bits = 64 - (registers.bit_length() - 1)
    at = np.searchsorted(h, np.arange(registers, dtype=np.uint64) << np.uint64(bits))
    end = np.append(at[1:], len(h))
    full = at < end
    rest = h[np.minimum(at, len(h) - 1)] & np.uint64((1 << bits) - 1)
    m, e = np.frexp(rest.astype(np.float64))
    out = ((bits - e) << mantissa) + np.clip((m - 0.5) * 2 * (1 << mantissa), 0, (1 << mantissa) - 1).astype(np.int64)
    if not full.all():
        hole = np.flatnonzero(~full)
        out[hole] = out[probes[hole, full[probes[hole]].argmax(1)]]
    return out.astype(np.uint16)


def collision(n: np.ndarray, m: np.ndarray, registers: int, mantissa: int) -> np.ndarray:
    """Probability that registers of unrelated sets of n and m elements agree: equal leading zeros, then equal mantissa bits."""
    zeros = np.arange(1, 48)
    lam = [np.maximum(x, 1)[:, None] / registers * 2.0 ** -zeros for x in (n, m)]
    p = [np.exp(-x) - np.exp(-2 * x) for x in lam]
    return (p[0] * p[1]).sum(1) * 2.0**-mantissa


def estimate(match: np.ndarray, n: np.ndarray, m: np.ndarray, registers: int = REGISTERS, mantissa: int = MANTISSA) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the share that agrees by chance."""
    c = collision(n, m, registers, mantissa)
    return (match / registers - c) / (1 - c)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_key, registers): set_key is a 128-bit digest of the full set, null for an empty one."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("registers", T.BinaryType())])
    arrow = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("registers", pa.binary())])

    def sign(batches):
        probes = probe_order(REGISTERS)
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                h = shingles((text or b"").lower().split(), k)
                out.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), hyperminhash(h, REGISTERS, MANTISSA, probes).tobytes()) if len(h) else (0, None, None))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], arrow.types[i + 1]) for i in range(3))], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(tidy(sign), schema)


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, shingles array) of the documents in ids."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def sets(batches):
        for b in batches:
            out = [shingles((t or b"").lower().split(), k).view(np.int64) for t in b.column(1).to_pylist()]
            at = np.cumsum([0, *map(len, out)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, np.concatenate([*out, np.empty(0, np.int64)]))], names=["doc_id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return keep_ids(texts, ids, "doc_id").mapInArrow(tidy(sets), schema)


def spread(pairs: DataFrame, left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """left joined with right by b, where left holds the pairs (a, b) of a written table, with other columns.

    A pivot that is in many pairs would be one task's: its row on the right is copied for each SPREAD of them.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts")).where("parts > 1")
    parts = materialize(parts, "hot", n)
    hot = parts.count()
    if not hot:
        return left.join(right, "b")
    parts = F.broadcast(parts) if hot <= BROADCAST_IDS else parts
    left = left.join(parts, "b", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    right = right.join(parts, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, ["b", "part"]).drop("part")


def verify(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    pairs = materialize(pairs.select("a", "b"), "asked", n)
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = spread(pairs, left, sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), n)
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    return both.where(f"{DEN} * bigint(i) >= {NUM} * bigint(n - i)").select("a", "b").distinct()


def scored(pairs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of a written table with their estimates; those that can't reach the similarity by size or estimate go."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    both = spread(pairs, pairs.join(side("a"), "a"), side("b"), n).where(f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)")

    def match(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
                est = estimate((x == y).sum(1), b.column(2).to_numpy(), b.column(3).to_numpy())
                keep = pa.array(est >= LEAST_ESTIMATE)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(est)], names=["a", "b", "est"]).filter(keep)

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(tidy(match), "a long, b long, est double")


def banded(reps: DataFrame) -> DataFrame:
    """(bucket, doc_id): a row for each band of compressed registers; four 16-bit registers are the key."""

    def keys(batches):
        salt = (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        for b in batches:
            if b.num_rows:
                r = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, BANDS)
                key = (r ^ salt) * np.uint64(0xD6E8FEB86659FD93)
                key = (key ^ (key >> np.uint64(32)) ^ salt).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["bucket", "doc_id"])

    return reps.select("doc_id", "registers").mapInArrow(tidy(keys), "bucket long, doc_id long")


def relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between different components, with the components (ca, cb)."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    out = edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return out.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")


def merged(labels: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """labels after the components that edges (ca, cb) connect are joined."""
    more = connected_components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    more = materialize(more, "cc-more", n).withColumnsRenamed({"node": "old", "component": "new"})
    moved = labels.join(more, labels.component == more.old, "left").select("node", F.coalesce("new", "component").alias("component"))
    return moved.union(more.join(labels, more.old == labels.node, "left_anti").select("old", "new"))


def unresolved(docs: DataFrame, bands: DataFrame, reps: DataFrame, labels: DataFrame, id_col: str, text_col: str, k: int, n: int) -> DataFrame:
    """Links (a, b) between different components that meet in a bucket, searched exhaustively on full sets.

    Buckets whose members are all connected add nothing and are left out. Every document of the others goes, with its
    full set, to one block: that of its most populous bucket, split by size. Blocks meet if they have a bucket in
    common, and are compared in numpy by size, estimate and intersection, so rows are made for links only, one for
    each two components that a pair of blocks connects, and never for a bucket's square.
    """
    member = bands.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_ = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    rows = materialize(member.join(open_.select("bucket", "n"), "bucket"), "open")
    home = rows.groupBy("doc_id", "component").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("home")).join(reps.groupBy("doc_id").agg(F.max("n_shingles").alias("size")), "doc_id")
    parts = home.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("parts"))
    home = materialize(home.join(parts, "home").withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), "parts"))).select("doc_id", "component", "block"), "home", n)
    near = rows.select("doc_id", "bucket").join(home, "doc_id").select("bucket", "block").distinct()
    meetings = near.withColumnRenamed("block", "p").join(near.withColumnRenamed("block", "q"), "bucket").where("p <= q").select("p", "q").distinct()
    sets = full_sets(docs, home.select("doc_id").distinct(), id_col, text_col, k).join(home, "doc_id")
    blocks = materialize(sets.groupBy("block").agg(F.collect_list(F.struct("doc_id", "component", "shingles")).alias("rows")), "blocks")

    def unpack(rows, probes):
        sets = [r["shingles"].values.to_numpy().view(np.uint64) for r in rows]
        registers = np.array([hyperminhash(h, REGISTERS, MANTISSA, probes) for h in sets])
        return [r["doc_id"].as_py() for r in rows], [r["component"].as_py() for r in rows], np.array(list(map(len, sets))), sets, registers

    def meet(batches):
        probes = probe_order(REGISTERS)
        for b in batches:
            for xs, ys in zip(b.column(0), b.column(1)):
                (i, ci, ni, si, ri), (j, cj, nj, sj, rj) = unpack(xs, probes), unpack(ys, probes)
                root = {c: c for c in (*ci, *cj)}

                def find(c):
                    while root[c] != c:
                        root[c] = c = root[root[c]]
                    return c

                for x in range(len(i)):
                    mine = find(ci[x])
                    far = np.array([find(c) != mine for c in cj])
                    u = np.flatnonzero(far & (DEN * np.minimum(ni[x], nj) >= NUM * np.maximum(ni[x], nj)))
                    if u.size:
                        u = u[estimate((ri[x] == rj[u]).sum(1), np.full(u.size, ni[x]), nj[u]) >= LEAST_ESTIMATE]
                    if not u.size:
                        continue
                    all_ = np.concatenate([sj[y] for y in u])
                    hit = si[x][np.minimum(np.searchsorted(si[x], all_), ni[x] - 1)] == all_
                    common = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *nj[u][:-1]]))
                    for y in u[DEN * common >= NUM * (ni[x] + nj[u] - common)]:
                        if find(ci[x]) != find(cj[y]):
                            root[find(ci[x])] = find(cj[y])
                            yield pa.RecordBatch.from_arrays([pa.array([i[x]]), pa.array([j[y]])], names=["a", "b"])

    pairs = meetings.join(blocks.select(F.col("block").alias("p"), F.col("rows").alias("x")), "p").join(blocks.select(F.col("block").alias("q"), F.col("rows").alias("y")), "q")
    with batches_of(docs.sparkSession, 4):
        links = materialize(pairs.select("x", "y").mapInArrow(tidy(meet), "a long, b long"), "links", n)
    drop(rows, home, blocks)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id), one row per row of docs.

    1. Equal sets become classes. 2. Registers are banded; in each bucket every class is compared with one pivot,
    which differs from bucket to bucket. 3. Each class's best pair is verified on full sets, then those of its
    other pairs that would still connect different components. 4. Buckets that still hold several components are
    searched exhaustively, block by block. A linked pair that shares a bucket (all but 5 in a million at the threshold
    itself) thus ends in one component, without pairs for the members of a group.
    """
    sig = materialize(signatures(docs, id_col, text_col, k), "signatures")
    n = sig.count()
    some = sig.where("n_shingles > 0 and doc_id is not null")
    # written before they are joined: a join of plain shuffles lets AQE split a hot set or bucket
    classes = materialize(some.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes", n)
    member = materialize(some.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep"), "members", n)
    own = classes.withColumnRenamed("rep", "doc_id")
    reps = materialize(some.join(own, ["set_key", "doc_id"]).dropDuplicates(["set_key", "doc_id"]).select("doc_id", "n_shingles", "registers"), "representatives")
    bands = materialize(banded(reps), "bands")

    mixed = F.col("doc_id").bitwiseXOR(F.xxhash64("bucket"))
    pivots = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min(mixed).alias("m")).where("n > 1")
    pivots = materialize(pivots.select("bucket", F.col("m").bitwiseXOR(F.xxhash64("bucket")).alias("b")), "pivots", n)
    star = bands.join(pivots, "bucket").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    star = materialize(star, "star")
    pairs = materialize(scored(star, reps, n), "pairs", n)
    drop(star)
    needed = materialize(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "doc_id"), "needed", n)
    sets = materialize(full_sets(docs, needed, id_col, text_col, k), "sets")

    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("est", F.xxhash64("a", "b"))).alias("b"))
    same = some.groupBy("doc_id").count().where("count > 1").select("doc_id")
    same = member.join(same, "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = materialize(connected_components(verify(best, sets, n).union(same)), "labels", n)
    more = relabel(pairs.select("a", "b"), labels)
    confirmed = verify(more, sets, n)
    labels = materialize(merged(labels, materialize(relabel(confirmed, labels), "links", n), n), "labels", n)
    drop(pairs, needed, sets, pivots, classes)
    links = unresolved(docs, bands, reps, labels, id_col, text_col, k, n)
    if not links.isEmpty():
        labels = materialize(merged(labels, relabel(links, labels), n), "labels", n)
    drop(bands, reps)

    of_rep = labels.withColumnsRenamed({"node": "rep", "component": "c"})
    ids = member.join(of_rep, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("c", "rep")).alias("component_id"))
    out = sig.select("doc_id", "n_shingles").join(ids, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row of docs for each component: that of its smallest doc_id, the least one if the id repeats. Null ids stay."""
    found = near_duplicates(docs, k=k)
    gone = materialize(found.where("not kept").select("doc_id").distinct(), "gone", docs.count())
    kept = keep_ids(docs, gone, "doc_id", "left_anti")
    again = materialize(kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again", docs.count())
    if again.isEmpty():
        return kept
    one = keep_ids(kept, again, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", *(c for c in docs.columns if c != "text"))).alias("_lm_row")).select(*(F.col(f"_lm_row.{c}") for c in docs.columns))
    return keep_ids(kept, again, "doc_id", "left_anti").unionByName(one)
