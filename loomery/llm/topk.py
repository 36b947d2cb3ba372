"""Exact top-k inner products by a pivot-distance index.

Components x become floor(scale * x), x as double; scale is a power of two, so floor(scale * x) / scale is a double
without loss, however large x is. Every vector is keyed by its nearest pivot and its distance to it; a cell holds the
vectors of one length, one number format, one pivot and one annulus of distances. A query takes the nearest cells
first, until they hold enough rows; that gives its k-th best score so far. Then it expands to every cell whose bound
allows that score or more: by the triangle inequality and the pivots' bisectors no vector of a cell is nearer than b,
so the inner product is at most (|q|^2 + greatest |x|^2 - b^2) / 2, and at most |q| |x|. The rest is never read, and the
result is exact: integers where they fit, wider integers for what floating point can't tell apart where they don't.

Pivots and annuli are fitted on at most PIVOT_ROWS rows (a documented bound); every row is indexed. Pivots grow with
the square root of the rows up to MOST_PIVOTS, annuli up to MOST_ANNULI, so cells are bounded for each vector length.
Cells are cut into blocks, so a vector that a third of the rows repeat fills many blocks. Cells and queries meet by
ids first; vectors travel once for each block they are compared with, in 2, 4 or 8 bytes a component.

Vectors null, or holding null or non-finite components, and null ids take no part. A query meets the vectors of its own
length, empty ones included (score 0). A score beyond a long is ranked by its true value and written as the nearest
long. Rows with the query's id are its own; a repeated query id is asked once, with the first of its vectors by length,
format and bytes. Repeated candidates each count. Empty tables and tables without queries give no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import batches_of, drop, materialize, tidy

MOST_PIVOTS, MOST_ANNULI, PIVOT_ROWS, ASK = 256, 16, 10_000, 512
#: Rows of a block, fewer for vectors of more than BLOCK_VALUES / BLOCK components.
BLOCK, BLOCK_VALUES = 2048, 2**20
#: Rows that the first, nearest cells must hold for each row asked for.
FIRST = 20
#: Formats: scaled components as 16-bit or 32-bit integers, unscaled doubles, doubles whose squares may overflow.
FORMATS = (np.int16, np.int32, np.float64, np.float64)
GIANT = 1e280
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def exact_doubles(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, y: array of floor(scale * x) / scale) of the rows that take part."""
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    ok = F.expr(f"`{vector_col}` is not null and not exists(`{vector_col}`, x -> x is null or isnan(double(x)) or abs(double(x)) = double('infinity'))")
    y = F.expr(f"transform(`{vector_col}`, x -> if(abs(double(x)) >= {2**53 // scale}D, double(x), floor({scale} * double(x)) / {scale}D))")
    return vectors.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), y.alias("y"))


class Pivots:
    """Pivots, fitted on vectors of one length and cut or filled with zeros for others, and annuli by quantiles."""

    def __init__(self, sample: list[np.ndarray], count: int, annuli: int):
        sizes = Counter(map(len, sample))
        dim = max(sizes, key=lambda n: (sizes[n], n)) if sizes else 0
        x = np.array([v for v in sample if len(v) == dim > 0], float).reshape(-1, max(dim, 1))
        with np.errstate(over="ignore"):
            x = np.unique(x[(x * x).sum(1) < GIANT], axis=0)
        rng = np.random.default_rng(11)
        at = [int(rng.integers(len(x)))] if len(x) else []
        far = ((x - x[at[0]]) ** 2).sum(1) if at else []
        while len(at) < min(count, len(x)):
            at.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
        self.p = x[at] if at else np.zeros((1, max(dim, 1)))
        for _ in range(8 if at else 0):
            near = self.distances(x).argmin(1)
            self.p = np.array([x[near == i].mean(0) if (near == i).any() else self.p[i] for i in range(len(self.p))])
        self.annuli, self.cuts = annuli, {}
        d = self.distances(x)
        near, dist = d.argmin(1), d.min(1)
        for i in np.unique(near):
            self.cuts[dim, int(i)] = np.quantile(dist[near == i], np.arange(1, annuli) / annuli)

    def distances(self, x: np.ndarray) -> np.ndarray:
        k = min(x.shape[1], self.p.shape[1])
        p = self.p[:, :k]
        d = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x[:, :k] @ p.T
        return np.sqrt(np.maximum(d, 0))

    def ring(self, dim: int, near: np.ndarray, dist: np.ndarray) -> np.ndarray:
        out = np.zeros(len(near), np.int64)
        for i in np.unique(near):
            if (cuts := self.cuts.get((dim, int(i)))) is not None:
                out[near == i] = np.searchsorted(cuts, dist[near == i], "right")
        return out

    def cell(self, dim: int, code: int, near, ring):
        """One number for length, format, pivot and annulus; the last pivot number is for vectors that have none."""
        return ((dim * len(FORMATS) + code) * (len(self.p) + 1) + near) * self.annuli + ring

    def parts(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, format and pivot of cells."""
        head, near = divmod(cell // self.annuli, len(self.p) + 1)
        return head // len(FORMATS), head % len(FORMATS), near


def lengths_of(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths without overflow on the way."""
    most = np.abs(x).max(1, initial=0)
    return most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1))


def encoded(y: np.ndarray, scale: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(format, rows, their values) for the formats that rows of y need."""
    most = np.abs(y).max(1, initial=0)
    squares = (y * y).sum(1)
    code = np.where(most * scale < 2**15, 0, np.where(most * scale < 2**31, 1, np.where(squares < GIANT, 2, 3)))
    return [(int(c), at := np.flatnonzero(code == c), (y[at] * scale).astype(FORMATS[c]) if c < 2 else y[at]) for c in np.unique(code)]


def decoded(column: pa.Array, dim: int, code: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), FORMATS[code]).reshape(len(column), dim) if dim else np.zeros((len(column), 0), FORMATS[code])


def plain(x: np.ndarray, code: int, scale: int) -> np.ndarray:
    return x / scale if code < 2 else x


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def whole(y: np.ndarray, scale: int) -> list[int]:
    return [int(v * scale) if abs(v) < 2.0**1000 else int(v) * scale for v in y.tolist()]


def wide_top(ids: np.ndarray, x: np.ndarray, query: int, q: np.ndarray, k: int, scale: int) -> list[tuple[int, int]]:
    """The k best (-score, id) of a block in integers of any width; floating point rules out what can't be among them."""
    x, q = x[ids != query], q[None]
    ids = ids[ids != query]
    big, mine = np.abs(x).max(initial=0) or 1.0, np.abs(q).max(initial=0) or 1.0
    xs, qs = x / big, q / mine
    s = xs @ qs[0]
    slack = (x.shape[1] + 4) * 2.0**-50 * lengths_of(xs) * lengths_of(qs)[0] + 1e-290
    if len(ids) > k:
        near = np.flatnonzero(s + slack >= np.partition(s - slack, -k)[-k])
    else:
        near = np.arange(len(ids))
    rows, back = np.unique(x[near], axis=0, return_inverse=True)
    ints = whole(q[0], scale)
    scores = [sum(a * b for a, b in zip(whole(r, scale), ints)) for r in rows]
    return sorted((-scores[j], i) for j, i in zip(np.ravel(back).tolist(), ids[near].tolist()))[:k]


def written(score: int) -> tuple[int, str]:
    """A score as the nearest long, and a text that orders what is beyond it."""
    if LONG_MIN < score <= LONG_MAX:
        return score, ""
    if score == LONG_MIN:
        return score, "~"
    digits = str(abs(score))
    key = f"{len(digits):06d}{digits}"
    return (LONG_MAX, key) if score > 0 else (LONG_MIN, "".join(str(9 - int(c)) for c in key))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", figures: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows where is_query holds, against all rows but their own.

    figures: a dictionary that gets the numbers of cells, queries and (query, cell) pairs searched.
    """
    spark = vectors.sparkSession
    rows = exact_doubles(vectors, id_col, vector_col, scale)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.where(F.rand(11) < PIVOT_ROWS / n).limit(PIVOT_ROWS).select("y").toPandas()["y"].to_list()
    count = int(np.clip(n**0.5 / 4, 16, MOST_PIVOTS))
    pivots = Pivots(sample, count, int(np.clip(n / count / 512, 4, MOST_ANNULI)))

    def key(batches):
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == dim))
                y = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    for code, at, v in encoded(y, scale):
                        m = len(at)
                        if code == 3:
                            near, dist, norm, ring = np.full(m, len(pivots.p)), np.zeros(m), np.full(m, np.inf), 0
                        else:
                            d = pivots.distances(y[at])
                            near, dist, norm = d.argmin(1), d.min(1), (y[at] ** 2).sum(1)
                            ring = pivots.ring(dim, near, dist)
                        cell, size = pivots.cell(dim, code, near, ring), v.dtype.itemsize * dim
                        data = v.tobytes()
                        values = pa.array([data[i * size : (i + 1) * size] for i in range(m)], pa.binary())
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), values, pa.array(cell.astype(np.int64)), pa.array(dist), pa.array(norm), pa.array(lengths_of(y[at]))], names=["vec_id", "v", "cell", "dist", "norm", "length"])

    keyed = materialize(rows.mapInArrow(tidy(key), "vec_id long, v binary, cell long, dist double, norm double, length double"), "keyed")
    cells = keyed.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("norm"), F.max("length").alias("length")).orderBy("cell").toPandas()
    cell, held, low, high, norm, longest = (cells[c].to_numpy() for c in ("cell", "n", "lo", "hi", "norm", "length"))
    dims, codes, of = pivots.parts(cell)

    def cut(per: dict[int, int]) -> DataFrame:
        """(cell, parts): how many blocks each cell has."""
        return F.broadcast(spark.createDataFrame([(int(c), int(p)) for c, p in per.items()] or [], "cell long, parts int"))

    block = np.clip(BLOCK_VALUES // np.maximum(dims, 1), 1, BLOCK)
    blocks = keyed.join(cut(dict(zip(cell, -(-held // block)))), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), "parts"))
    stored = materialize(blocks.groupBy("cell", "part").agg(F.collect_list(F.struct("vec_id", "v")).alias("r")).select("cell", F.col("r.vec_id").alias("ids"), F.col("r.v").alias("vs")), "cells")
    asked = keyed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("cell", "v")).alias("r"))
    asked = materialize(asked.select(F.col("vec_id").alias("query_id"), F.col("r.cell").alias("at"), "r.v"), "asked")

    def upper(q: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """For each query and cell, the greatest inner product that the bounds allow."""
        with np.errstate(over="ignore", invalid="ignore"):
            qn, ql = (q * q).sum(1), lengths_of(q)
            d = pivots.distances(q)
            mine = np.concatenate([d, np.zeros((len(q), 1))], 1)[:, of[cols]]
            near = np.maximum(np.maximum(mine - high[cols], low[cols] - mine), (mine - d.min(1)[:, None]) / 2)
            all_ = 1 + norm[cols][None] + qn[:, None]
            by_distance = (qn[:, None] + norm[cols][None] - np.maximum(near - 1e-6 * (1 + mine), 0) ** 2) / 2 + 1e-6 * all_
            by_length = np.nan_to_num(ql[:, None] * longest[cols][None], nan=np.inf, posinf=np.inf) * (1 + 1e-9) + 1e-9
            return np.where(np.isfinite(all_), np.minimum(by_distance, by_length), by_length)

    def route(first: bool):
        def run(batches):
            for b in batches:
                own_dim, own_code, _ = pivots.parts(b.column(1).to_numpy())
                for dim, code in sorted(set(zip(own_dim.tolist(), own_code.tolist()))):
                    part = b.filter(pa.array((own_dim == dim) & (own_code == code)))
                    q = plain(decoded(part.column(2), dim, code), code, scale)
                    cols = np.flatnonzero(dims == dim)
                    u = upper(q, cols)
                    order = np.argsort(-u, axis=1, kind="stable")
                    ahead = held[cols][order].cumsum(1)
                    head = np.zeros(u.shape, bool)
                    np.put_along_axis(head, order, np.concatenate([np.full((len(q), 1), True), ahead[:, :-1] < FIRST * k], axis=1), 1)
                    go = head if first else ~head & (u >= part.column(3).to_numpy(zero_copy_only=False)[:, None])
                    i, j = np.nonzero(go)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[cols[j]].astype(np.int64)), part.column(0).take(pa.array(i))], names=["cell", "query_id"])

        return run

    def evaluate(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rest: dict[int, list[tuple[int, int]]] = {}

        def flush():
            out = [(q, i, int(s), "") for q, (ids, scores) in best.items() for i, s in zip(ids.tolist(), scores.tolist())]
            out += [(q, i, *written(-s)) for q, found in rest.items() for s, i in found]
            best.clear()
            rest.clear()
            for at in range(0, len(out), 10_000):
                q, i, s, t = zip(*out[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(t, pa.string())], names=["query_id", "vec_id", "score", "beyond"])

        for b in batches:
            for r in range(b.num_rows):
                (dim,), (code,), _ = pivots.parts(np.array([b.column(0)[r].as_py()]))
                ids, x = b.column(1)[r].values.to_numpy(), decoded(b.column(2)[r].values, dim, code)
                qs, (_, form, _), vs = b.column(3)[r].values.to_numpy(), pivots.parts(b.column(4)[r].values.to_numpy()), b.column(5)[r].values
                for c in np.unique(form).tolist():
                    at = np.flatnonzero(form == c)
                    q = decoded(vs.take(pa.array(at)), dim, c)
                    most = float(np.abs(x.astype(float)).max(initial=1)) * float(np.abs(q.astype(float)).max(initial=1)) * max(dim, 1) if max(code, c) < 2 else np.inf
                    if most >= 2.0**62:
                        wide_x = plain(x, code, scale)
                        for name, one in zip(qs[at].tolist(), plain(q, c, scale)):
                            rest[name] = sorted(rest.get(name, []) + wide_top(ids, wide_x, name, one, k, scale))[:k]
                        continue
                    s = (q.astype(float) @ x.T.astype(float)).astype(np.int64) if most < 2.0**52 else q.astype(np.int64) @ x.T.astype(np.int64)
                    for i, name in enumerate(qs[at].tolist()):
                        other = ids != name
                        have = best.get(name, (np.empty(0, np.int64),) * 2)
                        all_, sc = np.concatenate([have[0], ids[other]]), np.concatenate([have[1], s[i][other]])
                        keep = top(all_, sc, k)
                        best[name] = all_[keep], sc[keep]
            if len(best) + len(rest) > 50_000:
                yield from flush()
        yield from flush()

    pairs = 0

    def search(queries: DataFrame, first: bool) -> DataFrame:
        """The best of what queries find in the cells they go to: ids meet cells, then vectors join in blocks."""
        nonlocal pairs
        routed = materialize(queries.mapInArrow(tidy(route(first)), "cell long, query_id long"), "routed")
        per = {r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}
        pairs += sum(per.values())
        ask = {c: -(-m // ASK) for c, m in per.items()}
        q = routed.join(cut(ask), "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts")).join(asked, "query_id")
        q = q.groupBy("cell", "part").agg(F.collect_list(F.struct("query_id", "at", "v")).alias("r")).select("cell", F.col("r.query_id").alias("qs"), F.col("r.at").alias("as"), F.col("r.v").alias("qv"))
        with batches_of(spark, 8):
            found = materialize(stored.join(q, "cell").select("cell", "ids", "vs", "qs", "as", "qv").mapInArrow(tidy(evaluate), "query_id long, vec_id long, score long, beyond string"), "found")
        drop(routed)
        return found

    found = search(asked, True)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    kth = F.when(F.col("score") == LONG_MIN, F.lit(float("-inf"))).otherwise(F.col("score").cast("double") / float(scale * scale))
    mark = found.withColumn("rank", place).where(F.col("rank") == k).select("query_id", kth.alias("mark"))
    rest = asked.join(mark, "query_id", "left").select("query_id", "at", "v", F.coalesce("mark", F.lit(float("-inf"))).alias("mark"))
    both = found.union(search(rest, False))
    if figures is not None:
        figures |= {"cells": len(cell), "queries": asked.count(), "pairs": pairs}
    drop(keyed, stored, asked)
    return both.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
