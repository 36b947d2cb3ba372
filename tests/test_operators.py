"""Operators against brute force on generated rows, and their edge cases."""

import itertools
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from loomery.functions import similarity as sim
from loomery.functions import text as X
from loomery.operators import dedup as D
from loomery.operators import metrics as M
from loomery.operators import split as S
from loomery.operators import state as St
from loomery.operators.tables import keep_table


def words(seed, n, vocabulary=12):
    r = random.Random(seed)
    return [(i, " ".join(r.choices([f"w{k}" for k in range(vocabulary)], k=r.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_pairs_are_all_pairs(spark, threshold):
    rows = words(1, 60)
    c = D.classes(spark.createDataFrame(rows, "id long, text string"), "id", X.words(F.col("text")))
    member = {}
    for r in c.collect():
        member.setdefault(r["rep"], []).append((r["id"], len(r["s"])))
    got = {tuple(sorted(p)) for v in member.values() if v[0][1] for p in itertools.combinations([i for i, _ in v], 2)}
    for r in D.similar_pairs(c.where("id = rep"), threshold).collect():
        got |= {tuple(sorted((i, j))) for i, _ in member[r["a"]] for j, _ in member[r["b"]]}
    want = set()
    for (a, x), (b, y) in itertools.combinations(rows, 2):
        x, y = set(x.split()), set(y.split())
        if x and y and len(x & y) / len(x | y) >= threshold:
            want.add((a, b))
    assert got == want


def test_survivors_are_the_greedy_pass(spark):
    r = random.Random(3)
    ids, edges = range(40), [tuple(sorted(r.sample(range(40), 2))) for _ in range(60)]
    kept = []
    for i in ids:
        if not any((j, i) in edges for j in kept):
            kept.append(i)
    got = D.survivors(spark.range(40), spark.createDataFrame(edges, "a long, b long"), keep_table)
    assert sorted(x["id"] for x in got.collect()) == kept


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10)] + [(20, 21)], "a long, b long")
    got = {r["node"]: r["component"] for r in D.components(edges, keep_table).collect()}
    assert got == {**{i: 0 for i in range(11)}, 20: 20, 21: 20}
    assert D.components(edges.limit(0), keep_table).count() == 0


def test_containment_with_short_texts(spark):
    big = spark.createDataFrame([(1, "xx abcdefgh yy"), (2, "one two three four"), (3, None)], "big long, t string")
    small = spark.createDataFrame([(7, "cdef"), (8, "two three"), (9, "wo three fo"), (10, "zzzz")], "small long, t string")
    got = D.contained(big, "big", X.text("t"), small, "small", X.text("t"), least=4)
    assert sorted((r["big"], r["small"]) for r in got.collect()) == [(1, 7), (2, 8), (2, 9)]


def test_ratio_split_sizes(spark):
    got = D.ratio_split(spark.range(103), "id", {"train": 0.6, "val": 0.2, "test": 0.2}).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 61, "val": 20, "test": 22}


def test_group_split_keeps_groups_and_shares(spark):
    r = random.Random(5)
    rows = [(i, f"g{i if r.random() < .7 else r.randint(0, 20)}", r.choice("aaab")) for i in range(400)]
    got = S.group_split(spark.createDataFrame(rows, "id long, g string, label string"), "g", "label").collect()
    assert len(got) == 400
    of = {}
    for x in got:
        assert of.setdefault(x["g"], x["split"]) == x["split"]
    share = sum(x["split"] == "train" for x in got) / 400
    assert 0.6 < share < 0.8


def test_group_split_of_many_signatures(spark):
    """Each class is within one group of its targets, though no two groups need have the same counts."""
    r = random.Random(11)
    rows, largest = [], 0
    for g in range(3000):
        counts = {c: r.randint(0, m) for c, m in (("a", 4), ("b", 6), ("c", 30), ("d", 200)) if r.random() < 0.6}
        largest = max([largest, *counts.values()])
        rows += [(f"g{g}", c, n) for c, n in counts.items() if n]
    df = spark.createDataFrame(rows, "g string, label string, n int").select("g", "label", F.explode(F.sequence(F.lit(1), "n")))
    got = S.group_split(df, "g", "label").groupBy("label", "split").count().collect()
    total = {c: sum(x["count"] for x in got if x["label"] == c) for c in "abcd"}
    assert sum(total.values()) == sum(n for _, _, n in rows)
    for x in got:
        assert abs(x["count"] - S.SPLITS[x["split"]] * total[x["label"]]) <= largest, x
    assert S.group_split(df.limit(0), "g", "label").count() == 0


@pytest.mark.parametrize("k", [1, 4])
def test_top_similar_is_brute_force(spark, k):
    from loomery.operators.setjoin import top_similar

    rows = [(i, sorted(set(t.split()))) for i, t in words(4, 90)] + [(200, ["w1", "w2"]), (201, ["w1", "w2"]), (202, ["w2", "w1"]), (203, []), (204, ["alone"])]
    df = spark.createDataFrame(rows, "id long, s array<string>")
    got = {(r["q"], r["rank"]): (r["h"], pytest.approx(r["score"])) for r in top_similar(df.where("id % 3 = 0 or id > 199"), df, k, 0.2).collect()}
    want = {}
    for i, x in rows:
        if i % 3 == 0 or i > 199:
            near = sorted((-like(set(x), set(y)), j) for j, y in rows if j != i and x and y and like(set(x), set(y)) > 0.2)
            want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(near[:k])}
    assert got == want and len(want) > 20


def test_top_similar_moves_no_candidates(spark):
    """Texts with everyday words in common: what is shuffled must not be the pairs of a query and a text (360,000 here)."""
    from loomery.operators.setjoin import top_similar

    def stages():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        found = sc.statusStore().stageList(None, False, False, none, None)
        return {(x := found.apply(i)).stageId(): x.shuffleWriteRecords() for i in range(found.size())}

    everyday = [f"e{i}" for i in range(30)]
    df = spark.createDataFrame([(i, [*everyday, f"r{i % 50}", f"x{i}"]) for i in range(1200)], "id long, s array<string>")
    before = max(stages(), default=-1)
    got = top_similar(df.where("id % 4 = 0"), df, 5).collect()
    assert len(got) == 300 * 5 and all(r["h"] == [h for h in range(r["q"] % 50, 1200, 50) if h != r["q"]][r["rank"] - 1] and r["score"] == 31 / 33 for r in got)
    assert sum(n for stage, n in stages().items() if stage > before) < 30_000


def test_top_similar_odd_rows(spark):
    """Repeated and missing ids, empty and missing sets, queries that the history lacks, more blocks than one, other kinds of ids."""
    from loomery.operators.setjoin import top_similar

    rng = random.Random(5)
    rows = [(i % 70 if i < 90 else i, sorted({f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randint(1, 25))})) for i in range(400)]
    rows += [(None, ["w1", "w2"]), (500, None), (501, []), (502, ["w1", "w2"]), (503, ["w1", "w2"])]
    asked = [r for r in rows if r[0] is not None and r[0] % 7 < 3] + [(900, ["w3", "w4", "w5"]), (None, ["w1"]), (901, None)]
    want = []
    for q in {r[0] for r in asked} - {None}:
        near = [(-like(set(x), set(y)), j) for i, x in asked for j, y in rows if i == q and j not in (None, q) and x and y and like(set(x), set(y)) > 0.3]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(near)[:4])]
    for kind, name in (("long", lambda i: i), ("string", lambda i: i if i is None else f"{i:04d}")):
        a, b = (spark.createDataFrame([(name(i), s) for i, s in x], f"id {kind}, s array<string>").repartition(3) for x in (asked, rows))
        got = [(r["q"], r["rank"], r["h"], r["score"]) for r in top_similar(a, b, 4, 0.3).collect()]
        assert sorted(got) == sorted((name(q), n, name(h), pytest.approx(s)) for q, n, h, s in want) and len(want) > 300
    assert top_similar(a.limit(0), b, 4).count() == top_similar(a, b.limit(0), 4).count() == 0


def test_q_fold(spark):
    rows = spark.createDataFrame([("k", 1, 1.0), ("k", 2, 0.0), ("k", 3, -1.0)], "key string, ts int, r double")
    assert St.q_fold(rows, "key", ["ts"], F.col("r")).first()["q"] == pytest.approx(-0.019)


def test_metrics_of_perfect_and_empty(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "b")], "t string, p string")
    one = M.summary(M.per_class(M.confusion(rows, "t", "p"))).first()
    assert one["accuracy"] == 1.0 and one["macro_f1"] == 1.0
    assert M.per_class(M.confusion(rows.limit(0), "t", "p")).count() == 0


def test_text_forms(spark):
    row = spark.createDataFrame([(" A  B\n", "ﬁx", "x> y\n> gone\nkept", None)], "a string, b string, c string, d string")
    got = row.select(X.norm_basic("a").alias("a"), X.norm_compat("b").alias("b"), X.drop_quoted(F.col("c")).alias("c"), X.norm_basic("d").alias("d"), X.sanitize_xml(F.lit("a\x00b\r\nc")).alias("x"), X.truncate_cell(F.lit("abcdef"), 5, "..").alias("t")).first()
    assert tuple(got) == ("a b", "fix", "x> y\nkept", "", "ab\nc", "abc..")


def test_similarity_edges(spark):
    row = spark.createDataFrame([("", ""), ("abc", "abc"), ("abc", "abd"), ("abcde", "abcdf")], "a string, b string")
    got = [tuple(r) for r in row.select(sim.char_jaccard(F.col("a"), F.col("b")), sim.jaccard(sim.word_set(F.col("a")), sim.word_set(F.col("b")))).collect()]
    assert got == [(1.0, 1.0), (1.0, 1.0), (0.0, 0.0), (pytest.approx(1 / 3), 0.0)]


def test_ask_and_grid(spark):
    from pyspark.ml.linalg import Vectors

    from loomery.operators import learn as L

    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, p string")
    got = L.ask(df, "p", "out", lambda: lambda texts: [x.upper() for x in texts]).orderBy("id").collect()
    assert [r["out"] for r in got] == ["A", None]
    rows = spark.createDataFrame([(Vectors.dense([float(i % 2), 1.0]), "odd" if i % 2 else "even") for i in range(40)], ["features", "y"])
    best = L.grid(rows, rows.withColumn("truth", F.col("y")), "y", [{"c": 1.0, "iterations": 5}, {"c": 0.1, "iterations": 5}], lambda p: p.where("pred = truth").count())
    assert best[0][0] == 40


def test_present_and_require(spark):
    from loomery.operators import validate as V

    df = V.present(spark.createDataFrame([(1,)], "a long"), {"a": "long", "b": "string"})
    assert df.columns == ["a", "b"] and V.require(df, 1, "rows") is df
    with pytest.raises(ValueError):
        V.require(df, 2, "rows")


def near_texts(seed=4, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out)[1].split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(["alpha", "beta", "gamma!"])
            if r.random() < 0.2:
                w = w[: max(3, len(w) // 2)]
        else:
            w = [f"word{r.randint(0, 40)}" for _ in range(r.randint(3, 30))]
        out.append((len(out), " ".join(w)))
    return out


def gram_set(t):
    return {t[i : i + 4] for i in range(len(t) - 3)}


def like(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def first_rows(rows):
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    return [(i, t) for t, i in first.items()]


def test_alike_is_all_pairs(spark):
    rows = first_rows(near_texts())
    got = {(r["a"], r["b"]): (r["word_sim"], r["char_sim"]) for r in D.alike(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"), keep_table).collect()}
    want = {}
    for (i, x), (j, y) in itertools.combinations(rows, 2):
        w, c = like(set(x.split()), set(y.split())), like(gram_set(x), gram_set(y))
        if min(len(x), len(y)) >= 15 and min(len(x), len(y)) >= 0.7 * max(len(x), len(y)) and (w >= 0.8 or c >= 0.85):
            want[(i, j)] = (pytest.approx(w), pytest.approx(c))
    assert got == want and len(want) > 10


def test_greedy_pass_by_rules(spark):
    rows = first_rows(near_texts(6, 80))
    kept = []
    for i, t in rows:
        dup = any(
            len(t) >= 20 and len(p) >= 20 and ((min(len(t), len(p)) >= 30 and (t in p or p in t)) or (abs(len(t) - len(p)) < 0.4 * len(t) and like(gram_set(t), gram_set(p)) >= 0.85))
            for _, p in kept
        )
        if not dup:
            kept.append((i, t))
    df = keep_table(spark.createDataFrame(rows, "id long, t string"))
    edges = D.greedy_edges(df, "id", F.col("t"), keep_table)
    for most in (20_000, 0):  # passes over whole components, then rounds
        assert sorted(r["id"] for r in D.survivors(df, edges, keep_table, most).collect()) == [i for i, _ in kept]
    assert len(kept) < len(rows)


@pytest.mark.parametrize("t", [0.5, 0.75, 0.8, 0.85, 0.9, 0.99])
def test_keys_of_parts_lose_no_pair(t):
    """Sets of all sizes that differ as much as the threshold allows agree on all but so many parts, and their parities on all but so many bits."""
    import numpy as np

    from loomery.operators.setjoin import Parts

    rng, parts = np.random.default_rng(7), Parts(t)
    for n in [*range(1, 60), 100, 333, 1000, 4000]:
        for _ in range(8):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            gone = int(rng.integers(0, int(n * (1 - t)) + 1))
            new = max(0, int((n - gone) / t - n + 1e-9))
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)]))
            if len(np.intersect1d(x, y)) >= t * len(np.union1d(x, y)):
                c = min(max(parts.classes(len(x))), max(parts.classes(len(y))))
                assert c in parts.classes(len(x)) and c in parts.classes(len(y))
                apart, many = parts.scheme(c)
                assert np.intersect1d(parts.keys(x, c), parts.keys(y, c)).size >= many - apart > 0, (n, gone, new)
                differ = np.bitwise_count((parts.parity(x, c) ^ parts.parity(y, c)).view(np.uint64)).sum()
                assert differ <= len(np.setxor1d(x, y)) <= (len(x) + len(y)) * (1 - t) / (1 + t) + 1e-9


def test_tf_idf_is_the_formula(spark):
    import math

    from loomery.operators import learn as L

    rows = spark.createDataFrame([(0, "red red blue"), (1, "blue GREEN"), (2, None)], "id long, t string")
    tf = L.TfIdf(4, (1, 2)).fit(rows, "t")
    assert set(tf.vocabulary) == {"blue", "red", "blue green", "green"} or len(tf.vocabulary) == 4
    got = {r["id"]: r["features"] for r in tf.transform(rows, "t").collect()}
    raw = {k: (1 + math.log(n)) * tf.idf[tf.vocabulary[k]] for k, n in tf.terms("red red blue").items() if k in tf.vocabulary}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert {k: pytest.approx(x / norm) for k, x in raw.items()} == {k: got[0][tf.vocabulary[k]] for k in raw}
    assert got[2].numNonzeros() == 0
    assert len(L.CONFIGS) == 11 and len({c[0] for c in L.CONFIGS}) == 11


def test_tuning_picks_on_check_rows(spark):
    from loomery.operators import learn as L

    r = random.Random(2)
    made = [(i, " ".join(r.choices(["win", "cash"] if i % 2 else ["meet", "plan"], k=6)), "spam" if i % 2 else "ham", "low" if i % 2 else "high") for i in range(60)]
    parts = [keep_table(spark.createDataFrame(made[k::3], "id long, t string, a string, b string")) for k in range(3)]
    tried, best = L.tune(*parts, "t", ("a", "b"), keep_table, L.CONFIGS[:2], iterations=20)
    assert [x["score"] for x in tried] == sorted((x["score"] for x in tried), reverse=True) and best["f1"] == {"a": 1.0, "b": 1.0}


def test_multi_task_and_latency(spark):
    from pyspark.ml.linalg import Vectors

    from loomery.operators import learn as L

    rows = keep_table(spark.createDataFrame([(i, Vectors.dense([float(i % 2), float(i % 3), 1.0]), i % 2, f"k{i % 3}") for i in range(120)], ["id", "features", "a", "b"]))
    heads, table = L.multi_task(rows, ["a", "b"], "id")
    assert set(heads) == {"a", "b"} and {r["field"]: r["macro_f1"] for r in table.collect()} == {"a": 1.0, "b": 1.0}
    with pytest.raises(ValueError):
        L.multi_task(rows.limit(3), ["a"], "id")
    calls = []
    took = L.latency(lambda x: calls.append(len(x)) or x, lambda x: x, list(range(8)))
    assert calls == [5] + [1] * 8 and took["total_ms"] >= 0 and L.latency(None, None, [])["total_ms"] == 0.0


def test_short_texts_bypass_the_model(spark):
    from loomery.operators import learn as L

    df = spark.createDataFrame([(1, "Hi", "ok"), (2, "Report", "please read the whole long report"), (3, "Empty", "the model says nothing about this")], "id long, s string, b string")
    load = lambda: lambda texts: ["" if "nothing" in x else "SUMMARY" for x in texts]
    got = {r["id"]: r["summary"] for r in L.summarized(df, "s", "b", load).collect()}
    assert got == {1: "Hi: ok", 2: "SUMMARY", 3: "Empty. the model says nothing about this..."}


def test_language_is_learned(spark):
    from loomery.operators.language import CharModel

    text = {"en": "the quick brown fox and the lazy dog with your friends in the house", "de": "der schnelle braune fuchs und der faule hund mit ihren freunden im haus"}
    rows = spark.createDataFrame([(n, t) for n, t in text.items()], "lang string, t string")
    model = CharModel().fit(rows, "lang", "t")
    asked = spark.createDataFrame([("the house of the friends and the fox",), ("das haus der freunde und der fuchs",), ("short",), (None,)], "t string")
    assert [r["language"] for r in model.detect(asked, "t").collect()] == ["en", "de", "unknown", "unknown"]


def test_language_of_documents_holds(spark):
    from loomery import plans

    out = plans.QUERIES["language_detect"](spark, "/root/testdata/sf0.01").where("length(language) = 2").selectExpr("avg(cast(not disagrees as int)) a", "count(*) n").first()
    assert out["n"] > 300 and out["a"] > 0.9


def test_polarity(spark):
    from loomery.functions import analysis as A

    df = spark.createDataFrame([("good good bad",), ("not good",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(A.polarity("t", {"good": 0.7, "bad": -0.7})).collect()] == [0.23, -0.35, 0.0, 0.0]


def test_contexts_are_remembered_for_a_while(spark):
    now = [0.0]
    rows = spark.createDataFrame([("u", "p", i, f"m{i}") for i in range(5)], "u string, p string, ts int, m string")
    c = St.RecentContexts(rows, "u", "p", "ts", clock=lambda: now[0], most=1)
    assert [r["m"] for r in c.get("u", "p")] == ["m4", "m3", "m2"]
    c.messages = rows.limit(0)
    now[0] = 299.0
    assert len(c.get("u", "p", 2)) == 2
    now[0] = 301.0
    assert c.get("u", "p") == [] and c.get("x", "p") == [] and len(c.kept) == 1


def test_reset_and_root_causes(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "log"))
    assert St.reset(spark, f"file://{tmp_path}/log") and not (tmp_path / "log").exists()
    causes = M.root_causes(("a", "b", 30), {"low": 0.9, "high": 0.1}, 0, 2, 0.02, 0.1)
    assert [c["impact"] for c in causes] == ["High", "High", "Low", "Medium", "Low"] and causes[0]["evidence"] == "a -> b: 30 rows"
    assert M.root_causes(None, {}, 0, 0, 0.0, 0.0)[0]["evidence"] == "no confusion"


def test_classifier_and_variants(spark, tmp_path):
    """A saved classifier scores raw texts as before; variants share a table, and the threshold is the best composite's."""
    from loomery.operators import learn as L

    r = random.Random(9)
    words = {"high": "urgent server down now", "medium": "please review this report", "low": "weekly news digest offer"}
    rows = [(i, k, " ".join(r.choices(words[k].split() + ["the", "a", "of"], k=6)), float(k == "high")) for i in range(240) for k in [r.choice(["high", "medium", "low", "low"])]]
    df = keep_table(spark.createDataFrame(rows, "id long, priority string, text string, signal double"))
    one = L.Classifier(L.TfIdf(50)).fit(df, "text", ["priority"], keep_table, 30)
    one.save(str(tmp_path / "c"))
    scored = lambda c: {x["id"]: (x["priority_pred"], round(x["priority_pred_confidence"], 9)) for x in c.predict(df, "text").collect()}
    before = scored(one)
    assert scored(L.Classifier.load(str(tmp_path / "c"))) == before and len(before) == 240
    x = L.TfIdf(50).fit(df, "text").transform(df, "text").withColumn("plain", F.col("features"))
    x = keep_table(L.hybrid(x, "features", ["signal"]).select("id", "priority", "plain", "features"))
    heads = L.heads_of(x.where("id < 160"), "priority", iterations=30)
    assert set(heads) == {v[0] for v in L.VARIANTS}
    alone = L.Head(1.0, 30).fit(x.where("id < 160"), "priority")
    assert heads["Hybrid_Engineered_Balanced"].model.coefficientMatrix.toArray() == pytest.approx(alone.model.coefficientMatrix.toArray(), abs=1e-6)
    got = L.compared(heads, x.where("id >= 160"), "priority").collect()
    assert len(got) == 4 + len(L.THRESHOLDS) and sum(g["selected"] for g in got) == 1
    swept = [g for g in got if g["name"] == "Hybrid_Engineered_Balanced"]
    best = max(swept, key=lambda g: (g["composite"], -g["threshold"]))
    assert best["selected"] and best["composite"] == pytest.approx(0.4 * best["recall"] + 0.3 * best["f1"] + 0.3 * best["macro_f1"])


def test_mean_of_decimals_is_that_of_any_order(spark):
    low = [178.42, 174.63, 10.51, 99.77, 32.37, 15.2]  # doubles add up to less than 85.15 times 6
    rows = [(1, v) for v in low] + [(2, 1.0), (2, None), (3, None), (4, float("inf")), (4, 1.0), (5, 1e30), (5, 3e30)]
    got = dict(spark.createDataFrame(rows, "k long, v double").groupBy("k").agg(F.round(St.mean("v"), 1)).collect())
    assert got == {1: 85.2, 2: 1.0, 3: None, 4: float("inf"), 5: 2e30}


def test_alike_writes_less_than_the_texts(spark):
    r = random.Random(11)
    rows = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=2000))) for i in range(150)]
    rows += [(1000 + i, t[:1950] + "x" * 50) for i, t in rows[:5]]
    folders = []

    def keep(df):
        folders.append(keep_table(df))
        return folders[-1]

    df = keep_table(spark.createDataFrame(rows, "id long, t string"))
    assert {(p["a"], p["b"]) for p in D.alike(df, "id", F.col("t"), keep).collect()} == {(i, 1000 + i) for i in range(5)}
    written = sum(p.stat().st_size for t in folders for p in pathlib.Path(t._loomery_path.removeprefix("file:")).rglob("*.parquet"))
    assert written < 150 * 2000 / 4  # sets of 4-grams alone take 8 bytes a character


def many_near_texts():
    """Families of near copies, larger than what a set of a block meets at first, and texts of their own."""
    r, rows = random.Random(5), []
    for f in range(6):
        t = "".join(r.choices("abcdefgh ", k=400))
        for _ in range(5 if f else 60):
            i = r.randrange(380)
            rows.append(t[:i] + "".join(r.choices("xyz", k=r.randrange(3))) + t[i + 2 :])
    r.shuffle(rows)
    return first_rows(list(enumerate(rows)))


@pytest.mark.parametrize("few", [2**17, 40, 0])
def test_blocks_and_keys_meet_all_pairs(spark, few):
    """Classes of few sets meet in blocks, others by keys: both, or one of them, find the same, all pairs or enough to join them."""
    from loomery.operators import setjoin as J

    rows = many_near_texts()
    df = keep_table(spark.createDataFrame(rows, "id long, t string"))
    kinds = [(0.8, J.word_numbers), (0.85, D.grams)]
    like_ = {(i, j) for (i, x), (j, y) in itertools.combinations(rows, 2) if like(gram_set(x), gram_set(y)) >= 0.85 or like(set(x.split()), set(y.split())) >= 0.8}
    met = J.Meetings(df, kinds, keep_table, few)
    got = [(p["a"], p["b"]) for p in met.pairs().collect()]
    assert like_ <= set(got) and len(got) == len(set(got)) < len(rows) ** 2 / 4
    links = {(p["a"], p["b"]) for p in met.spanning(lambda p: p.join(spark.createDataFrame(sorted(like_), "a long, b long"), ["a", "b"]), lambda e: D.components(e, keep_table)).collect()}
    assert links <= like_ and reached(links) == reached(like_)


def test_blocks_link_a_family_through_some(spark):
    from loomery.operators import setjoin as J

    df = keep_table(spark.createDataFrame(many_near_texts(), "id long, t string"))
    taken = []

    def accept(pairs):
        taken.append(pairs.count())
        return pairs

    met = J.Meetings(df, [(0.85, D.grams)], keep_table)
    assert met.met is None  # no key of a part travels
    met.spanning(accept, lambda e: D.components(e, keep_table)).collect()
    assert taken[0] + sum(taken[1:]) < met.pairs().count() / 2


def reached(links):
    group = {}
    for a, b in sorted(links):
        ga, gb = group.setdefault(a, {a}), group.setdefault(b, {b})
        if ga is not gb:
            ga |= gb
            for x in gb:
                group[x] = ga
    return {frozenset(g) for g in group.values()}
