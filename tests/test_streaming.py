"""Streams over files, run to their end, against the batch result."""

import datetime as dt

import pytest

from loomery.streaming import state as Z


def run(spark, df, mode, tmp_path):
    name = f"s{abs(hash(str(tmp_path))) % 10**8}"
    with Z.typed_state(spark):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    return spark.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, d), float(v), f"word{d} common") for d, v in ((1, 1), (2, 0), (3, -1))] + [("b", dt.datetime(2024, 1, 1), 5.0, "x")]
    schema = "key string, ts timestamp, r double, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_counters(spark, stream, tmp_path):
    got = {r["key"]: (r["total"], r["positive"], r["negative"]) for r in run(spark, Z.counters(stream, "key", "r"), "update", tmp_path).collect()}
    assert got == {"a": (3, 1, 1), "b": (1, 1, 0)}


def test_learned_values(spark, stream, tmp_path):
    got = {r["key"]: r["q"] for r in run(spark, Z.learned_values(stream, "key", "ts", "r"), "update", tmp_path).collect()}
    assert got["a"] == pytest.approx(-0.019) and got["b"] == pytest.approx(0.1)


def test_contexts(spark, stream, tmp_path):
    got = {(r["key"], r["ts"].day): list(r["context"]) for r in run(spark, Z.contexts(stream, ["key"], "ts", "text", n=2), "append", tmp_path).collect()}
    assert got[("a", 3)] == ["word1 common", "word2 common"] and got[("b", 1)] == []


def test_windows_and_last_tags(spark, stream, tmp_path):
    got = run(spark, Z.windowed(stream, "ts", "key"), "update", tmp_path / "w").collect()
    assert sum(r["n"] for r in got) == 4
    tags = run(spark, Z.last_tags(stream, "key", "text", "ts"), "update", tmp_path / "t").collect()
    assert {r["key"]: r["preferred"] for r in tags}["a"] == "word3 common"
