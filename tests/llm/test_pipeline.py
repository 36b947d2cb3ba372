"""The pipeline on the smallest tables, stage by stage, and on awkward rows."""

from collections import Counter

from helpers import docs, empty
from pyspark.sql import functions as F
from test_documents import WORD, brute_counts, reachable

import corpus_pipeline as P
from loomery.llm import mixing, quality, secrets


def test_stages_chain(spark):
    folder = "/root/testdata/sf0.001"
    out = P.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    d = spark.read.parquet(f"{folder}/documents.parquet")
    n = d.count()
    for name, stage in P.STAGES[:-1]:
        d2 = stage(spark, d, folder)
        assert d2.columns == d.columns
        m = d2.count()
        assert m <= n if name in ("quality", "near_dedup") else m > 0
        d, n = P.materialize(d2, name), m


def test_stages_take_awkward_rows(spark):
    for make in (docs, empty):
        d = make(spark)
        for name, stage in P.STAGES[:-1]:
            out = P.materialize(stage(spark, make(spark), "/root/testdata/sf0.001"), name)
            assert out.columns == d.columns and out.count() <= 3 * max(1, d.count())
        assert P.STAGES[-1][1](spark, make(spark), "").count() >= d.count()


def test_stages_do_what_their_operators_say(spark):
    """Every stage on the smallest tables against brute force or its operator's decisions, row by row."""
    folder = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(P.STAGES)
    rows = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    before = rows(d)

    kept = P.materialize(stages["quality"](spark, d, folder), "q")
    good = {r["doc_id"] for r in quality.judge(d, labels).where("kept").collect()}
    for i, r in before.items():
        n = brute_counts(r["text"] or "")
        assert not (i in good and (n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert rows(kept) == {i: r for i, r in before.items() if i in good}

    one = P.materialize(stages["near_dedup"](spark, kept, folder), "d")
    of = reachable([(i, r["text"]) for i, r in rows(kept).items()])
    assert set(rows(one)) == set(of.values())

    clean = P.materialize(stages["secrets"](spark, one, folder), "s")
    spans = rows(secrets.scan(one.withColumn("repo", F.concat_ws("/", "source", "lang"))))
    for i, r in rows(clean).items():
        text, out, at = before[i]["text"], [], 0
        for s in spans[i]["spans"]:
            if s["verdict"] == "live":
                if s["start"] >= at:
                    out += [text[at : s["start"]], f"[{secrets.KINDS[s['kind']]}]"]
                at = max(at, s["end"])
        assert r["text"] == "".join(out) + text[at:] and r["n_chars"] == len(r["text"])

    mix = P.materialize(stages["mixing"](spark, clean, folder), "m")
    took = {r["doc_id"]: r["taken"] for r in mixing.mix(clean).collect() if r["taken"]}
    words = Counter()
    for r in mix.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == Counter(took)

    packed = stages["packing"](spark, mix, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mix.collect())
    fill = Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and sum(fill.values()) <= 4096 * len(fill)
    assert len(fill) <= -(-sum(fill.values()) // 4096) * 1.01 + 1


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "packing"]
