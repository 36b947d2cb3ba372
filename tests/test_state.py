"""Keyed stores, ordered scans of hot keys, exact quantiles and typed streaming state."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomery.operators import scan as S
from loomery.operators.store import Conflict, Store, stream_into
from loomery.streaming import state as Z

SCHEMA = "k long, ts int, v string"


def content(store, version=None):
    return sorted(map(tuple, store.read(version).collect()), key=repr)


def test_store_merges_expires_and_compacts(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t", ["k"], "ts", buckets=4)
    with pytest.raises(LookupError):
        s.read()
    rows = lambda *r: spark.createDataFrame(r, SCHEMA)
    s.merge(rows((1, 1, "a"), (2, 5, "b"), (None, 2, "n")))
    s.merge(rows((1, 3, "newer"), (2, 4, "older"), (3, 1, "c")))
    now = [(1, 3, "newer"), (2, 5, "b"), (3, 1, "c"), (None, 2, "n")]
    assert content(s) == sorted(now, key=repr) and content(s, 1) == sorted([(1, 1, "a"), (2, 5, "b"), (None, 2, "n")], key=repr)
    s.merge(rows((2, 9, "no"), (4, 4, "first"), (4, 6, "second"), (None, 8, "no")), only_new=True)
    assert content(s) == sorted([*now, (4, 4, "first")], key=repr)
    s.expire(3)
    kept = [(1, 3, "newer"), (2, 5, "b"), (4, 4, "first")]
    assert content(s) == kept
    s.merge(rows((3, 1, "back")))
    for _ in range(2):
        s.compact()
        assert content(s) == sorted([*kept, (3, 1, "back")])
    assert s.manifest()["deltas"] == s.manifest()["cuts"] == []
    assert s.vacuum() > 0 and s.vacuum() == 0 and content(s) == sorted([*kept, (3, 1, "back")])
    base = s.manifest()["base"]
    s.merge(rows((3, 2, "again")))
    s.compact()
    assert sum(s.manifest()["base"][b] != base[b] for b in base) == 1  # one bucket is written anew


def test_killed_and_rival_writes(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/t", ["k"], "ts", buckets=2)
    rows = spark.createDataFrame([(1, 1, "a")], SCHEMA)
    s.merge(rows)

    def dies(manifest):
        raise OSError("lost")

    monkeypatch.setattr(s, "_commit", dies)
    with pytest.raises(OSError):
        s.merge(rows.withColumn("v", F.lit("b")).withColumn("ts", F.lit(2)))
    monkeypatch.undo()
    assert content(s) == [(1, 1, "a")] and s.vacuum() == 1
    old = s.manifest()
    s.merge(rows.withColumn("k", F.lit(2).cast("long")))
    with pytest.raises(Conflict):
        s._commit(old)
    assert s.merge(rows, mark=("job", 3)) == 3 and s.merge(rows, mark=("job", 3)) == 3 and s.merge(rows, mark=("job", 4)) == 4


def brute(rows, n=3, rate=0.1):
    out, seen = {}, {}
    for k, at, v, r in sorted(rows, key=lambda x: x[1]):
        before, q, total = seen.get(k, ([], 0.0, 0))
        out[at] = ([x for x in before[-n:] if x is not None], total + r)
        seen[k] = ([*before, v], q + rate * (r - q), total + r)
    return out, {k: (q, len(b)) for k, (b, q, _) in seen.items()}


@pytest.mark.parametrize("hot", [0, 50, 10**6])
def test_scans_of_hot_keys(spark, hot):
    """A third of all rows, and more, are of one key; the same answers with plain windows, some pieces or only pieces."""
    rnd = random.Random(hot)
    rows = [(rnd.choice([None, "a", "hot", "hot"]), i, rnd.choice([None, f"v{i}"]), rnd.randrange(3)) for i in range(300)]
    want, last = brute(rows)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v string, r long").repartition(3)
    order = [F.col("at")]
    got = {r["at"]: list(r["c"]) for r in S.preceding(df, ["k"], order, "v", 3, "c", hot).collect()}
    assert got == {i: c for i, (c, _) in want.items()}
    got = {r["at"]: r["s"] for r in S.running(df, ["k"], order, {"s": F.col("r")}, hot).collect()}
    assert got == {i: s for i, (_, s) in want.items()}
    got = {r["k"]: (r["q"], r["n"]) for r in S.folded(df, ["k"], order, F.col("r"), 0.1, hot).collect()}
    assert got == {k: (pytest.approx(q), n) for k, (q, n) in last.items()}
    assert S.preceding(df.limit(0), ["k"], order, "v", 3, "c", hot).count() == 0


def test_pieces_are_even(spark):
    df = spark.range(0, 40_000).select(F.when(F.col("id") % 10 < 3, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("at"))
    sizes = [r["count"] for r in S.pieces(df, ["k"], [F.col("at")]).groupBy("_piece").count().collect()]
    assert max(sizes) <= 3 * statistics.median(sizes) and len(sizes) == S.parts(df)


@pytest.mark.parametrize("hot", [0, 100, None])
def test_quantiles_are_exact(spark, hot):
    import numpy as np

    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", "b", "b", None]), rnd.choice([None, 7.0, 7.0, rnd.random() * 20])) for _ in range(500)] + [("one", 3.5), ("none", None)]
    got = {r["k"]: (r["m"], r["p"], r["lo"], r["hi"]) for r in S.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), {"m": 0.5, "p": 0.95, "lo": 0.0, "hi": 1.0}, hot).collect()}
    for k in {k for k, _ in rows} - {"none"}:
        v = [x for j, x in rows if j == k and x is not None]
        assert got[k] == tuple(pytest.approx(float(np.quantile(v, p))) for p in (0.5, 0.95, 0, 1))
    assert "none" not in got


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))


def test_contexts_restart_without_repeats(spark, tmp_path):
    """Two runs over growing input with one checkpoint: the second goes on from the first's state and repeats nothing."""
    schema, at = "key string, ts timestamp, text string", lambda d: dt.datetime(2024, 1, d)
    store = Store(spark, f"file://{tmp_path}/store", ["key", "ts"], buckets=2)

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with Z.typed_state(spark):
            q = stream_into(store, Z.contexts(stream, ["key"], "ts", "text", n=2, days=30), f"file://{tmp_path}/checkpoint", "contexts", only_new=True)
            q.awaitTermination(120)

    write(spark, tmp_path, "in", [("a", at(1), "w1"), ("a", at(2), "w2"), ("b", at(1), "x")], schema)
    go()
    first = store.manifest()
    go()
    assert store.manifest() == first or store.read().count() == 3
    write(spark, tmp_path, "in", [("a", at(3), "w3"), ("b", dt.datetime(2024, 3, 20), "late")], schema)
    go()
    got = {(r["key"], r["text"]): list(r["context"]) for r in store.read().collect()}
    assert got == {("a", "w1"): [], ("a", "w2"): ["w1"], ("a", "w3"): ["w1", "w2"], ("b", "x"): [], ("b", "late"): []}
    write(spark, tmp_path, "in", [("a", dt.datetime(2024, 3, 25), "w4")], schema)  # what was said two months ago is forgotten
    go()
    assert {r["text"]: list(r["context"]) for r in store.read().collect()}["w4"] == []


def test_idle_keys_begin_anew(spark, tmp_path):
    schema = "key string, ts timestamp, r double"
    store = Store(spark, f"file://{tmp_path}/store", ["key"], buckets=2)

    def go(rows):
        write(spark, tmp_path, "in", rows, schema)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with Z.typed_state(spark):
            stream_into(store, Z.learned_values(stream, "key", "ts", "r", idle="10 days"), f"file://{tmp_path}/checkpoint", "values", "update").awaitTermination(120)
        return {r["key"]: (round(r["q"], 6), r["n"]) for r in store.read().collect()}

    day = lambda m, d: dt.datetime(2024, m, d)
    assert go([("a", day(1, 2), 0.0), ("a", day(1, 1), 1.0), ("a", day(1, 3), -5.0)]) == {"a": (-0.019, 3)}
    assert go([("a", day(1, 5), 1.0)])["a"] == (0.0829, 4)
    assert go([("b", day(3, 1), 1.0)])["b"] == (0.1, 1)
    assert go([("a", day(3, 2), 1.0)])["a"] == (0.1, 1)


def test_corrections_keep_counts(spark, tmp_path):
    schema = "sender string, tag string, at string"
    store = Store(spark, f"file://{tmp_path}/store", ["sender"], buckets=2)
    for rows in ([("s", "x", "1"), ("s", "y", "3"), ("s", None, "0")], [("s", "x", "2"), ("u", "z", "1")]):
        write(spark, tmp_path, "in", rows, schema)
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with Z.typed_state(spark):
            stream_into(store, Z.corrected_tags(stream, "sender", "tag", "at"), f"file://{tmp_path}/checkpoint", "tags", "update").awaitTermination(120)
    got = {r["sender"]: (r["preferred"], r["corrections"], r["tags"], round(r["confidence"], 6)) for r in store.read().collect()}
    assert got == {"s": ("y", 3, 2, 0.333333), "u": ("z", 1, 1, 1.0)}
