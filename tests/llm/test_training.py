"""Fill-in-the-middle, the conversation trie and decontamination against brute force, with every awkward row."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from helpers import LONG, docs, empty

from loomery.llm import decontam, fim, trie


def fim_of(i, text, seed=1):
    """n, form, prefix_chars, middle_chars, output of one document, unit by unit."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    odd = ["<", "<<S", "S>", "a<P>b", "<P", "P><S<M", "😀é\n\r\x00x", "x" * 70_000, LONG, None, "", "a"]
    more = spark.createDataFrame([(i, odd[(i or 0) % len(odd)], "clash", "clash") for i in [*range(240), -7, None]], "doc_id long, text string, form string, output string")
    for d in (docs(spark), more):
        got = fim.restored(fim.arranged(d)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
        want = [(r["doc_id"], *fim_of(r["doc_id"], r["text"]), r["text"] or "") for r in d.collect()]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.restored(fim.arranged(empty(spark))).count() == 0
    other = fim.arranged(more.withColumnsRenamed({"doc_id": "k", "text": "body"}), "k", "body", seed=2, plain=0, spm=100, marks=("[a]", "[b]", "[c]"))
    assert {r["form"] for r in other.select("form").distinct().collect()} == {"plain", "spm"}
    assert fim.restored(other, ("[a]", "[b]", "[c]")).where("text <> restored").isEmpty()


def trie_of(rows):
    """Every node of the rebuilt conversations, its subtree walked node by node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c > 0 else -1)
        paths[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(sums[k][0] for k in children[node]) or 1
        sums[node] = leaves, (len(members[node]) - 1) * words + sum(sums[k][1] for k in children[node])
        ends = ",".join(map(str, sorted(c for c in members[node] if len(paths[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "user", "assistant", None]), rnd.choice(["a b", "a  b\tc", "é\u00a0x y", None, ""])) for c in range(-45, 300) for t in range(rnd.randrange(1, 7)) if rnd.random() < 0.8]
    rows += [(7000 + c, t, "user", f"common turn {t}") for c in range(400) for t in range(3)]  # copies
    rows += [(9000, t, "user", f"turn {t // 2}") for t in range(3000)]  # one long conversation over all partitions
    rows += [(9001 + k, 0, "user", "only turn") for k in range(15)]  # some are left without a turn
    rows += rows[:50] + [(None, 1, "user", "lost"), (12, None, "user", "first"), (12, None, "assistant", "first"), (12, 3, "user", "x"), (12, 3, "user", "w"), (2**40 + 3, 0, None, None), (5, 0, "user", LONG)]
    schema = "conv_id long, turn int, role string, text string"
    for data in (rows, rows[:1], []):
        frame = spark.createDataFrame([(*r, "clash", 1) for r in data], schema + ", depth string, n_convs int").repartition(5)
        got = trie.trie(frame, block=7)
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert got.columns == names
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, trie_of(data)))
    assert any(r[:2] == (-45, 0) for r in trie_of(rows))


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def windows_of(text):
    w = item_words(text)
    return [w[i : i + 10] for i in range(max(1, len(w) - 9))] if w else []


def contaminated(text, items):
    w, hit, found = item_words(text), set(), set()
    for i, item in items:
        for x in windows_of(item):
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    found |= {str(i)} if i is not None else set()
    return len(w), len(hit), sorted(found)


def near(text, items, within=20):
    w, found = item_words(text), set()
    for i, item in items:
        for x in windows_of(item):
            for k in range(max(1, len(w))):
                if set(x) <= set(w[k : k + within]):
                    found.add(str(i))
    return sorted(found)


def awkward_benchmark():
    rnd = random.Random(5)
    words = ["the", "of", "Éa", "x1", "b", *(f"w{k}" for k in range(60))]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(k, text(rnd.choice([3, 9, 10, 11, 25]))) for k in range(12)]
    items += [(20, items[4][1]), (20, items[4][1]), (21, "the"), (22, ""), (23, None), (24, "-- !"), (25, "the the the"), (26, "never-seen word"), (None, items[5][1]), (100, "rest " + items[4][1].upper())]
    docs_ = [(k, text(rnd.randrange(0, 80))) for k in range(40)]
    for k in range(60):
        i = rnd.choice(items)[1] or ""
        w = i.split(" ")
        part = " ".join(w[rnd.randrange(3) :])
        docs_.append((100 + k, text(rnd.randrange(12)) + rnd.choice([" ", ", ", "\n"]) + rnd.choice([str.upper, str])(part) + "." + text(rnd.randrange(12))))
        rnd.shuffle(w)
        docs_.append((200 + k, " xx ".join(w[:3]) + " " + " ".join(w[3:])))
    docs_ += [docs_[50], docs_[50], (7, docs_[60][1]), (None, docs_[61][1]), (8, None), (9, ""), (10, "the " * 30_000), (11, LONG)]
    docs_ += [(1000 + k, f"u{k} " + items[4][1] + f" v{k}") for k in range(300)]  # a passage that a third of all documents share
    return docs_, items


def test_decontamination(spark, monkeypatch):
    docs_, items = awkward_benchmark()
    d = spark.createDataFrame([(*r, 1, "clash") for r in docs_], "doc_id long, text string, n_words int, t0 string").repartition(5)
    b = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, term string").repartition(3)
    want = sorted(repr((i, *contaminated(t, items))) for i, t in docs_)
    answers = lambda: sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in decontam.contamination(d, b).collect())
    assert answers() == want
    assert sum("[]" in x for x in want) > 20 < sum("[]" not in x for x in want)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_CANDIDATES", 0)
    assert answers() == want  # by shuffles
    monkeypatch.undo()
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert decontam.contamination(d, b.limit(0)).where("n_hit > 0 or contaminated or size(items) > 0").isEmpty()


def test_proximity(spark):
    docs_, items = awkward_benchmark()
    docs_, items = [r for r in docs_[:180] if r[0] != 10], [r for r in items if r[0] is not None]
    d = spark.createDataFrame(docs_, "doc_id long, text string").repartition(3)
    found, windows = decontam.proximity(d, spark.createDataFrame(items, "item_id long, text string"))
    ids = {r["item_set"]: r["item_ids"] for r in windows.collect()}
    got = sorted(repr((r["doc_id"], sorted({i for m in r["matches"] for i in ids[m["item_set"]]}))) for r in found.collect())
    assert got == sorted(repr((i, near(t, items))) for i, t in docs_)
    exact, _ = decontam.phrases(d, spark.createDataFrame(items, "item_id long, text string"))
    assert exact.where("size(matches) > 0").count() < found.where("size(matches) > 0").count()
