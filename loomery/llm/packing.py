"""Best-fit packing of tokenised documents by the linear grouping scheme.

Documents become token ids plus an end id; longer ones are cut into pieces of `capacity`, the last piece may be
shorter. How many pieces have each length is all that the plan needs: at most `capacity` numbers, so it is made on the
driver whatever the corpus. Large lengths are sorted into groups of equal cardinality and rounded up to their group's
greatest; column generation finds the configurations of these few sizes that need the fewest sequences; actual lengths
take the rounded slots and the room these leave; what is left over and the small lengths fill the gaps by best fit. Pieces of one length are
interchangeable, so a piece's place follows from its rank within its length, which a range sort gives.

Null texts are empty documents (the end id alone). Repeated rows are packed as rows of their own. An empty table gives
no rows. The tokenizer file is read on the driver and shipped with the tasks.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import with_prefix
from .workspace import drop, materialize, small_batches, tidy, worker_cache

CAPACITY = 4096
#: Schemes tried in turn: lengths of at least this share of the capacity are large; groups they are rounded to.
SCHEMES = ((1 / 8, 40), (1 / 6, 40), (1 / 4, 40), (1 / 3, 40))
#: Marks that may stand behind a word: no apostrophe, which may begin an ending.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Beyond Latin letters a lower-cased letter may join a mark; other white space than that of ASCII.
HARD = r"[^\x{0}-\x{2FF}]|[\x{1C}-\x{1F}\x{85}\x{A0}]"
#: Words whose ids a worker remembers.
MEMO = 600_000
#: Text that a worker encodes at once: more finds more repeated words, and is held in memory.
ENCODE_BYTES = 4 * 2**20


def encoder(model: str, end_id: int, most: int = MEMO):
    """texts -> for each, little-endian unsigned 32-bit ids and the end id, as bytes.

    The tokenizer never joins characters across white space, so words are encoded once and remembered. New words of
    letters are encoded as one text and told apart by the tokens that end a word, marks behind them stand for
    themselves, and other new words are encoded one by one. Separators 1C-1F, white space for Python but not for the tokenizer, send a text
    through it whole.
    """
    from tokenizers import Tokenizer

    cache = worker_cache()
    if cache.get("model") != model:
        tok = Tokenizer.from_str(model)
        ends = np.zeros(max(tok.get_vocab().values()) + 1, bool)
        ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
        cache |= {"model": model, "tokenizer": tok, "ends": ends, "memo": {}}
    tok, ends, memo, end = cache["tokenizer"], cache["ends"], cache["memo"], np.array([end_id], "<u4").tobytes()
    pack = lambda ids: np.array(ids, "<u4").tobytes()

    def learn(new: set[str]) -> None:
        plain, odd, marked = set(), set(), []
        for w in new:
            stem = w.rstrip(MARKS)
            if stem.isalpha() and stem.lower().isalpha():
                if stem not in memo:
                    plain.add(stem)
                if len(stem) < len(w):
                    marked.append((w, stem, tail := w[len(stem) :]))
                    if tail not in memo:
                        odd.add(tail)
            else:
                odd.add(w)
        plain = list(plain)
        ids = np.array(tok.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        stops = 4 * (np.flatnonzero(ends[ids]) + 1)
        if len(stops) == len(plain):
            memo.update(zip(plain, map(ids.tobytes().__getitem__, map(slice, [0, *(stops := stops.tolist())], stops))))
        else:
            odd.update(plain)
        odd = list(odd)
        memo.update(zip(odd, (pack(e.ids) for e in tok.encode_batch_fast(odd, add_special_tokens=False))))
        memo.update((w, memo[stem] + memo[tail]) for w, stem, tail in marked)

    def known(words: list[str]) -> list[bytes]:
        if len(memo) > most:
            memo.clear()
        if new := set(words).difference(memo):
            learn(new)
        return list(map(memo.__getitem__, words))

    def whole(text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return pack(tok.encode(text, add_special_tokens=False).ids)
        return b"".join(known(text.split()))

    def encode(texts: pa.StringArray) -> list[bytes]:
        texts = texts.fill_null("")
        hard = pc.match_substring_regex(texts, HARD)
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(hard, "", texts)))
        coded = words.flatten().dictionary_encode()
        ids = known(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        each = coded.indices.to_numpy(zero_copy_only=False)
        n = size[each]
        after = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[each] - (after - n), n) + np.arange(n.sum())
        flat = np.frombuffer(b"".join(ids), "<u4")[at]
        cuts = np.concatenate([[0], after])[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        return [(whole(texts[i].as_py()) if h else flat[cuts[i] : cuts[i + 1]].tobytes()) + end for i, h in enumerate(hard.to_pylist())]

    return encode


def gathered(batches, most: int):
    """Columns of two-column batches, joined until they hold so many bytes of text."""
    wait, size = [], 0
    for b in batches:
        wait.append(b)
        size += b.column(1).nbytes
        if size >= most:
            yield tuple(pa.concat_arrays([x.column(i) for x in wait]) for i in range(2))
            wait, size = [], 0
    if wait:
        yield tuple(pa.concat_arrays([x.column(i) for x in wait]) for i in range(2))


def pieces(docs: DataFrame, model: str, end_id: int, capacity: int, id_col: str, text_col: str, memo: int, batch: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)

    def cut(batches):
        encode = encoder(model, end_id, memo)
        for ids_, texts in gathered(batches, batch):
            rows = []
            for i, ids in zip(ids_.to_pylist(), encode(texts)):
                rows += [(i, n, at // 4, len(p := ids[at : at + 4 * capacity]) // 4, zlib.crc32(p)) for n, at in enumerate(range(0, len(ids), 4 * capacity))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (ids_.type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(tidy(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], need: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(slots for each size, sequences): fewest sequences for the fractional problem, rounded up.

    Column generation: the basis of one pattern for each size is improved while a knapsack over the dual prices
    finds a pattern worth more than one sequence.
    """
    k, s = len(sizes), np.array(sizes)
    basis = np.diag(capacity // s).astype(float)
    d = np.array(need, float)
    for _ in range(60 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for j in np.flatnonzero(price > 1e-12):
            w = sizes[j]
            for a in range(w, capacity + 1, w):  # one more piece of this size than in the stretch before
                with_it = best[a - w : a][: capacity + 1 - a] + price[j]
                now = best[a : a + w]
                more = with_it > now + 1e-12
                now[more], last[a : a + w][more] = with_it[more], j
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(k), capacity
        while last[c] >= 0:
            new[last[c]] += 1
            c -= s[last[c]]
        x, way = np.linalg.solve(basis, d), np.linalg.solve(basis, new)
        ratio = np.where(way > 1e-9, np.maximum(x, 0) / np.where(way > 1e-9, way, 1), np.inf)
        basis[:, ratio.argmin()] = new
    x = np.linalg.solve(basis, d)
    return [(basis[:, j].round().astype(int), math.ceil(x[j] - 1e-6)) for j in range(k) if x[j] > 1e-6]


def grouped(counts: dict[int, int], least: float, groups: int) -> dict[int, int]:
    """Lengths of at least `least` in groups of equal cardinality, greatest first: rounded size -> pieces."""
    large = [(x, n) for x, n in sorted(counts.items(), reverse=True) if n and x >= least]
    size = -(-sum(n for _, n in large) // groups)
    out: dict[int, int] = {}
    before = 0
    for x, n in large:
        while n:
            if before % size == 0:
                greatest = x
            take = min(n, size - before % size)
            out[greatest] = out.get(greatest, 0) + take  # groups that round to one size are one
            before, n = before + take, n - take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """((length, first rank, first sequence, pieces of it in a sequence, offset) ..., sequences).

    The scheme is laid out for each of SCHEMES, and the one with the fewest sequences is taken, the first on ties.
    Entries end a length or a class of equal sequences, so their number depends on the capacity, not on the corpus.
    """
    return min((arranged(counts, capacity, share * capacity, groups) for share, groups in SCHEMES), key=lambda x: x[1])


def arranged(counts: dict[int, int], capacity: int, least: float, groups: int) -> tuple[list, int]:
    """The plan with lengths of at least `least` rounded up to so many groups.

    Actual lengths are substituted for a configuration's rounded slots: each slot takes the greatest that is left and
    no longer than its size, the last one, and what room is left then, the greatest that fits. A configuration ends when
    its sequences are made or no large length is left; what is left over goes to the best fit with the small lengths.
    """
    sizes = grouped(counts, least, groups)
    found = configurations(list(sizes), list(sizes.values()), capacity) if sizes else []
    entries: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    left = dict(counts)
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, sequences)
    keys: list[int] = []
    total = 0

    def room(free: int, first: int, n: int) -> None:
        if n and free:
            if not rooms[free]:
                bisect.insort(keys, free)
            rooms[free].append((first, n))

    def put(length: int, n: int, first: int, per: int, at: int) -> None:
        entries.append((length, used[length], first, per, at))
        used[length] += n
        left[length] -= n

    large = sorted(x for x, n in left.items() if n and x >= least)
    shapes = sorted(([x for x, c in sorted(zip(sizes, slots), reverse=True) for _ in range(c)], n) for slots, n in found)
    for wanted, n in reversed(shapes):
        while n and large:
            free, picks = capacity, Counter()

            def pick(most: int) -> int:
                at = bisect.bisect_right(large, most) - 1
                while at >= 0 and picks[large[at]] >= left[large[at]]:
                    at -= 1
                return large[at] if at >= 0 else 0

            for i, x in enumerate(wanted):
                if y := pick(min(x, free) if i + 1 < len(wanted) else free):
                    picks[y] += 1
                    free -= y
            while y := pick(free):
                picks[y] += 1
                free -= y
            step = min([n, *(left[y] // m for y, m in picks.items() if m)])
            at = 0
            for y, m in sorted(picks.items(), reverse=True):
                for _ in range(m):
                    put(y, step, total, 1, at)
                    at += y
                if m and not left[y]:
                    large.pop(bisect.bisect_left(large, y))
            room(free, total, step)
            total, n = total + step, n - step
    for x in sorted(left, reverse=True):
        while (c := left[x]) > 0:
            i = bisect.bisect_left(keys, x)
            if i == len(keys):
                free, (first, n) = capacity, (total, -(-c // (capacity // x)))
                total += n
            else:
                free = keys[i]
                first, n = rooms[free].pop()
                if not rooms[free]:
                    keys.pop(i)
            per = free // x
            whole = min(n, c // per)
            if whole:
                put(x, whole * per, first, per, capacity - free)
                room(free - per * x, first, whole)
            more = min(c - whole * per, per) if whole < n else 0
            if more:
                put(x, more, first + whole, more, capacity - free)
                room(free - more * x, first + whole, 1)
            room(free, first + whole + bool(more), n - whole - bool(more))
    return entries, total


def pack(docs: DataFrame, model_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO, batch: int = ENCODE_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    memo: words a worker remembers, some 200 bytes each; batch: bytes of text it encodes at once, held some 30 times.
    """
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    cut = materialize(pieces(docs, model, end_id, capacity, id_col, text_col, memo, batch), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    entries, _ = plan(counts, capacity)
    before, at = {}, 0
    for x in sorted(counts):
        before[x], at = at, at + counts[x]
    table = by_length(entries)
    ranked = with_prefix(cut, [F.asc(c) for c in ("length", "doc_id", "piece", "start", "ids_crc32")], "length", "ranked")
    drop(cut)

    def place(batches):
        for b in batches:
            length, index = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_index"))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                rank, rows = index[at] - before[x], table[x]
                row = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                rank = rank - row[:, 0]
                seq[at], off[at] = row[:, 1] + rank // row[:, 2], row[:, 3] + rank % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = dict(ranked.dtypes)["doc_id"]
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_index").mapInArrow(tidy(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def by_length(entries) -> dict[int, np.ndarray]:
    found = defaultdict(list)
    for e in entries:
        found[e[0]].append(e[1:])
    return {x: np.array(rows) for x, rows in found.items()}
