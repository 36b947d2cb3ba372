"""Prefix trie of conversations by smallest-member ownership.

Conversations that start alike share nodes, and a node belongs to its smallest conversation. Members of a node are among
its parent's, so a conversation owns a suffix of its own path, and (owner, depth) names a node. Three steps follow:

1. Occurrences: a row for each conversation and depth, with running sums of turn digests (the node's key), of words, and
   with the parent's key. Sums run over a range sort by conversation and depth with offsets between partitions, so one
   conversation of any length is spread over tasks.
2. Ownership: the least member of each key (combined before the shuffle, so a node of a third of all conversations is
   one row a task), then the depth at which each conversation's own suffix begins, and whether it ends in a leaf.
3. One group-by on the prefix sums, for each member, its words from there on less the words of nodes it owns, the
   flags of a child and of a leaf that it owns; the smallest member is the node's name.

Ids of the conversations that end in a node are sorted, joined in blocks, and hashed block by block.

Turns are ordered by turn (null first), then role, then digest of role and text. Null roles and texts are empty; rows
without a conversation id belong to none and are left out; repeated rows are turns of their own. Words are runs of
characters other than space and \\x09-\\x0D. Only the four named columns are read. No conversation: no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running
from .workspace import batches_of, drop, materialize, partitions, tidy

#: Conversations whose ids are the same but for id % FAMILY start with turns of the first of them.
FAMILY, HEAD = 20, 4
#: Ids in a block of the list that is hashed.
BLOCK = 2048
WORDS = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k0", "k1", "k2", "k3"]


def own_turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, position (from 1), words, d0 to d3: the turns in order; d0 to d3 are 30-bit parts of a digest of role and text."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    parts = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long").bitwiseAND(2**30 - 1).alias(f"d{i}") for i in range(4)]
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("_digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("_digest")]
    return running(materialize(rows, "turns"), "conv_id", order, []).select("conv_id", F.col("_pos").alias("position"), "words", *parts)


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with the head of its family: conv_id, depth, words, d0 to d3; depth 0 is its textless start.

    The head is the first h = crc32(id) % HEAD turns of the conversation id - id % FAMILY; own turns follow after the first h.
    """
    digests = [f"d{i}" for i in range(4)]
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    sizes = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("position") < HEAD)).select(F.col("conv_id").alias("base"), F.col("position").alias("depth"), "words", *digests)
    lent = heads.groupBy("base").agg(F.max("depth").alias("available"))
    sizes = sizes.join(lent, "base", "left").withColumn("head", F.least("h", F.coalesce("available", F.lit(0))))
    sizes = materialize(sizes, "sizes")
    start = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *(F.lit(0).cast("long").alias(d) for d in digests))
    first = sizes.where("head > 0").join(heads, "base").where("depth <= head").select("conv_id", "depth", "words", *digests)
    own = turns.join(sizes.select("conv_id", "h", "head"), "conv_id").where("position > h").select("conv_id", (F.col("position") - F.col("h") + F.col("head")).alias("depth"), "words", *digests)
    return start.unionByName(first).unionByName(own)


def occurrences(path: DataFrame) -> DataFrame:
    """path with k0 to k3 (sums over the path down to here: the node's key), p0 to p3 (its parent's) and before (words above)."""
    mixed = F.sha2(F.concat_ws(":", "depth", *(f"d{i}" for i in range(4))), 256)
    hashed = path.withColumn("_h", mixed).select(
        "conv_id", "depth", "words", *(F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long").bitwiseAND(2**30 - 1)).cast("long").alias(f"s{i}") for i in range(4))
    )
    sums = running(materialize(hashed, "path"), "conv_id", [F.col("depth")], ["words", *(f"s{i}" for i in range(4))])
    keys = [F.col(f"_sum_s{i}").alias(f"k{i}") for i in range(4)]
    return sums.select("conv_id", "depth", "words", (F.col("_sum_words") - F.col("words")).alias("before"), *keys, *((F.col(f"_sum_s{i}") - F.col(f"s{i}")).alias(f"p{i}") for i in range(4)))


def ids_joined(ends: DataFrame, size: int) -> DataFrame:
    """KEY, conv_id -> KEY, first, ids: the ids of each key in numerical order, joined by commas in blocks of `size` at most."""
    schema = ends.select(*KEY).schema.add("first", "long").add("ids", "string")

    def run(batches):
        key, block = None, []

        def row():
            return (*key, block[0], ",".join(map(str, block)))

        for b in batches:
            out = []
            for *k, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key or len(block) == size:
                    if block:
                        out.append(row())
                    key, block = k, []
                block.append(i)
            yield rows_of(out)
        if block:
            yield rows_of([row()])

    def rows_of(out):
        columns = list(zip(*out, strict=True)) if out else [[]] * (len(KEY) + 2)
        kinds = [pa.int64()] * (len(KEY) + 1) + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*KEY, "first", "ids"])

    sorted_ids = ends.select(*KEY, "conv_id").repartitionByRange(partitions(ends.sparkSession), *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    return sorted_ids.mapInArrow(tidy(run), schema)


def digests_of(blocks: DataFrame) -> DataFrame:
    """KEY, ends_sha256: SHA-256 of each key's joined ids, block after block; what is held is one batch of blocks."""
    schema = blocks.select(*KEY).schema.add("ends_sha256", "string")

    def run(batches):
        key, digest = None, None

        def rows_of(out):
            columns = list(zip(*out, strict=True)) if out else [[]] * (len(KEY) + 1)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * len(KEY) + [pa.string()], strict=True)], names=[*KEY, "ends_sha256"])

        for b in batches:
            out = []
            for *k, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield rows_of(out)
        if key:
            yield rows_of([(*key, digest.hexdigest())])

    dealt = blocks.repartition(partitions(blocks.sparkSession), *KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids")
    return dealt.mapInArrow(tidy(run), schema)


def trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    turns = own_turns(conversations, id_col, turn_col, role_col, text_col)
    occ = occurrences(rebuilt(turns))
    paths = occ.groupBy("conv_id").agg(F.max("depth").alias("length"), F.sum("words").alias("total"))
    last = occ.join(paths.select("conv_id", "length"), "conv_id").withColumn("ends", F.col("depth") == F.col("length"))
    last = materialize(last, "occurrences")

    owners = last.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.min("before").alias("before"), F.count("*").alias("n"), F.count_if("ends").alias("n_ends"))
    begin = F.min(F.struct("depth", "before"))
    suffix = owners.groupBy("conv_id").agg(begin.alias("b"), F.max(F.col("n") == F.col("n_ends")).alias("leaf"))
    suffix = suffix.select("conv_id", F.col("b.depth").alias("own_from"), F.col("b.before").alias("shared"), "leaf")
    owned = paths.join(suffix, "conv_id", "left").select(
        "conv_id", "length", F.coalesce("own_from", F.col("length") + 1).alias("own_from"), F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(False)).alias("leaf")
    )
    owned = materialize(owned, "owned")

    member = last.join(owned.drop("length"), "conv_id")
    grown = F.col("depth") + 1
    nodes = member.groupBy(*KEY).agg(
        F.min(F.struct("conv_id", "own_from")).alias("owner"), F.min(F.struct("p0", "p1", "p2", "p3")).alias("parent"), F.count("*").alias("n_convs"),
        F.count_if(~F.col("ends") & (grown >= F.col("own_from"))).alias("n_children"), F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.lit(0), F.col("shared") - F.col("before"))).alias("saved_tokens"), F.count_if("ends").alias("n_ends"),
    )
    nodes = materialize(nodes.select(*KEY, F.col("owner.conv_id").alias("conv_id"), F.col("owner.own_from").alias("own_from"), "parent.*", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"), "nodes")
    with batches_of(spark, 256):
        blocks = materialize(ids_joined(last.where("ends"), block), "ends")
        ends = materialize(digests_of(blocks), "end_digests")
    drop(blocks)
    return linked(nodes).join(ends, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def linked(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id. Inside an owned suffix the parent's owner is the same; the root's is the least id of all;
    only where a suffix begins below depth 1 is the parent looked up, by a join whose hot keys AQE can split."""
    root = F.broadcast(nodes.agg(F.min("conv_id").alias("_least")))
    inner = nodes.where("depth > own_from or depth < 2").crossJoin(root)
    inner = inner.withColumn("parent_conv_id", F.when(F.col("depth") > F.col("own_from"), F.col("conv_id")).when(F.col("depth") == 1, F.col("_least"))).drop("_least")
    up = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(f"k{i}").alias(f"p{i}") for i in range(4)), F.col("conv_id").alias("parent_conv_id"))
    outer = nodes.where("depth <= own_from and depth > 1").join(up, ["depth", "p0", "p1", "p2", "p3"])
    return inner.unionByName(outer)
