"""Approximate nearest neighbours by learned partitions (operator 4).

1. On a sample of at most ``SAMPLE`` vectors (those of smallest hash) the graph of the nearest neighbours
   is made and cut into parts of equal size with few edges between them: recursive bisection, each
   refined by moving pairs of vertices to where more of their neighbours are.  There are about as many
   parts as the square root of the rows.  Parts that hold more than twice ``PART_ROWS`` are cut in the
   same way again, each on a sample of its own and in a task of its own; so up to 65,536 parts.
2. A small network learns from a vector the parts of its neighbours. It gives every vector of the table
   one part (the index) and every query several, the most probable first, until their probabilities add
   up to a mass: the smallest with which held-out sample queries find ``TARGET`` of their neighbours.
   A query that the network is sure about is searched for in few parts, another in more.
3. A query is compared with all rows of its parts, in blocks of bounded size, in double precision; blocks
   give their best, and a window keeps the best of all blocks.

Tables of fewer than ``LEAST`` vectors are one part.  Equal vectors of a block count once in the
comparison and keep as many of their smallest ids as a result can show.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as query or candidate; very large and very small components are scaled by powers
of two before they are squared; fewer candidates than asked for give as many rows as there are; equal
scores go by smaller id; rows without id take no part; rows that share an id are rows of their own, but
none is a neighbour of its own id, and queries that share an id have one list, the nearest to any of
them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import discard, stored

SAMPLE, PART_ROWS, MAX_PARTS, LEAST = 8192, 16_384, 256, 32
NEIGHBOURS, TARGET = 10, 0.97
#: Bytes of a block of rows, and of the queries that it is compared with at once.
BLOCK_BYTES, CHUNK = 8_000_000, 256


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest components lie between a half and one: their squares
    neither overflow nor vanish, and nothing is rounded."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row of unit vectors, block by block."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(rows: np.ndarray, x: np.ndarray, near: np.ndarray, rounds: int = 12) -> np.ndarray:
    """A balanced cut of some vertices: True for one half. Starts at the median of the main axis and
    swaps the vertices that gain most by changing sides, as many from either side."""
    y = x[rows] - x[rows].mean(0)
    axis = np.linalg.svd(y[: 2000], full_matrices=False)[2][0]
    side = np.zeros(len(rows), bool)
    side[np.argsort(y @ axis, kind="stable")[len(rows) // 2 :]] = True
    at = np.full(len(x), -1)
    at[rows] = np.arange(len(rows))
    to = at[near[rows]]
    src, dst = np.repeat(np.arange(len(rows)), to.shape[1]), to.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    u, v = np.concatenate([src, dst]), np.concatenate([dst, src])
    for _ in range(rounds):
        same = side[u] == side[v]
        gain = np.bincount(u[~same], minlength=len(rows)) - np.bincount(u[same], minlength=len(rows))
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        n = min(len(a), len(b))
        good = int((gain[a[:n]] + gain[b[:n]] > 0).sum()) // 2  # half: neighbours that move together undo their gains
        if not good:
            break
        side[a[:good]], side[b[:good]] = True, False
    return side


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Part numbers; ``parts`` is a power of two."""
    label = np.zeros(len(x), np.int64)
    for level in range(int(math.log2(parts))):
        for p in range(1 << level):
            rows = np.flatnonzero(label == p)
            if len(rows) > 1:
                label[rows[bisect(rows, x, near)]] += 1 << level
    return label


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float

    @property
    def parts(self) -> int:
        return len(self.b2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of unit vectors, [vector, part]."""
        z = np.maximum(x * math.sqrt(x.shape[1]) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The part of each vector in the index."""
        return self.probabilities(x).argmax(1)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, part): the parts to search for each vector."""
        order, before = _ordered(self.probabilities(x))
        i, rank = np.nonzero(before < self.mass)
        return i, order[i, rank]


def _ordered(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts by falling probability, and the mass of those before each."""
    order = np.argsort(-p, axis=1, kind="stable")
    falling = np.take_along_axis(p, order, axis=1)
    return order, np.cumsum(falling, axis=1) - falling


def train(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 25, batch: int = 256, rate: float = 0.003) -> list[np.ndarray]:
    """One hidden layer, softmax over the parts, Adam; target: per row the shares of the parts."""
    rng = np.random.default_rng(5)
    d, p = x.shape[1], target.shape[1]
    ws = [rng.normal(0, math.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), (hidden, p)), np.zeros(p)]
    m, v, t = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            i = order[lo : lo + batch]
            h = np.maximum(x[i] @ ws[0] + ws[1], 0)
            z = h @ ws[2] + ws[3]
            q = np.exp(z - z.max(1, keepdims=True))
            g = (q / q.sum(1, keepdims=True) - target[i]) / len(i)
            gh = (g @ ws[2].T) * (h > 0)
            t += 1
            for k, dw in enumerate((x[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[k] += 0.1 * (dw - m[k])
                v[k] += 0.001 * (dw * dw - v[k])
                ws[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return ws


def alone(dim: int) -> Router:
    """One part for all."""
    return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)


def learn(x: np.ndarray, parts: int, k: int = 5, target: float = TARGET) -> Router:
    """A router from a sample of vectors, to at most ``parts`` parts, a power of two."""
    u = np.unique(unit(x.astype(np.float64)), axis=0)
    while parts > 1 and 4 * parts > len(u):
        parts //= 2
    if parts < 2:
        return alone(x.shape[1])
    near = neighbour_graph(u, NEIGHBOURS)
    label = balanced_parts(u, near, parts)
    share = np.zeros((len(u), parts))
    np.add.at(share, (np.repeat(np.arange(len(u)), near.shape[1]), label[near].ravel()), 1.0)
    share[np.arange(len(u)), label] += 1
    share /= share.sum(1, keepdims=True)
    held = np.arange(len(u)) % 4 == 0 if len(u) < 2000 else np.arange(len(u)) % 8 == 0
    router = Router(*train(u[~held] * math.sqrt(u.shape[1]), share[~held]), mass=2.0)
    # rows are indexed by the network too, so it is its own parts in which neighbours have to be found
    p = router.probabilities(u)
    own, (order, before) = p.argmax(1), _ordered(p)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    best = neighbour_graph(u, k)
    need = np.take_along_axis(before, np.take_along_axis(rank, own[best], axis=1), axis=1)[held].ravel()
    # of few held-out neighbours more have to be found
    at = math.ceil((target * len(need) + 2) / (len(need) + 2) * len(need))
    router.mass = float(np.sort(need)[min(at, len(need)) - 1]) + 1e-9
    return router


def _valid(vec: Column, dim: int) -> Column:
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vec.isNotNull() & (F.size(vec) == dim) & fine & F.exists(vec, lambda v: v != 0)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _sampled(rows: DataFrame, sample: int, total: int) -> DataFrame:
    """About ``sample`` and never more than twice as many of ``total`` rows, by hash of their ids."""
    if total <= sample:
        return rows
    cut = math.ceil(1.3 * sample / total * (1 << 30))
    return rows.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < cut)


def _route(rows: DataFrame, first: Router, more: dict[int, Router], dim: int, many: bool) -> DataFrame:
    """(id, vec, part): each row with its part, or with each of the parts to be searched."""
    held = rows.sparkSession.sparkContext.broadcast((first, more))  # MAX_PARTS + 1 small networks at most

    def of(r: Router, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return r.search(x) if many else (np.arange(len(x)), r.own(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, under = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(_matrix(b.column(1), dim))
            i, part = of(top, x)
            rows_, parts = [], []
            for p in np.unique(part):
                mine = i[part == p]
                j, child = of(under[p], x[mine]) if p in under else (np.arange(len(mine)), np.zeros(len(mine), np.int64))
                rows_.append(mine[j])
                parts.append(p * MAX_PARTS + child)
            t = b.take(pa.array(np.concatenate(rows_)))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(np.concatenate(parts).astype(np.int32))], ["id", "vec", "part"])

    return rows.mapInArrow(run, "id long, vec array<double>, part int")


def _learn_parts(index: DataFrame, sizes: dict[int, int], part_rows: int, sample: int, dim: int, k: int, target: float) -> dict[int, Router]:
    """Routers within the parts that are too large, each learned in a task of its own."""
    large = {p: n for p, n in sizes.items() if n > 2 * part_rows}
    if not large:
        return {}
    cuts = [(p, math.ceil(min(1.0, 1.3 * sample / n) * (1 << 30)), min(MAX_PARTS, 1 << math.ceil(math.log2(n / part_rows)))) for p, n in large.items()]
    side = F.broadcast(index.sparkSession.createDataFrame(cuts, "part int, cut long, parts int"))  # MAX_PARTS rows at most
    some = index.join(side, "part").filter(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(1 << 30)) < F.col("cut"))

    def run(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("vec").combine_chunks(), dim)
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        r = learn(x[order], t.column("parts")[0].as_py(), k, target)
        data = pickle.dumps([a.astype(np.float32) for a in (r.w1, r.b1, r.w2, r.b2)] + [r.mass])
        return pa.table([pa.array([t.column("part")[0].as_py()], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

    got = some.select("part", "parts", "id", "vec").groupBy("part").applyInArrow(run, "part int, data binary").collect()
    return {r["part"] // MAX_PARTS: Router(*pickle.loads(r["data"])) for r in got}


def _best(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, cosine): of each query the k best candidates of a block, exactly, ties to the
    smaller id."""
    order = np.argsort(c_id, kind="stable")
    c_id, c = c_id[order], np.ascontiguousarray(scaled(c[order]))
    q = scaled(q)
    _, first, back = np.unique(c.view(np.dtype((np.void, c.dtype.itemsize * c.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(back.ravel(), kind="stable")  # ids of equal vectors, ascending
    size = np.bincount(back.ravel(), minlength=len(first))
    start = np.cumsum(size) - size
    v = c[first]
    nv = np.sqrt((v * v).sum(1))
    got = [_nearest(q_id[lo : lo + CHUNK], q[lo : lo + CHUNK], c_id, c, v, nv, by, size, start, k) for lo in range(0, len(q), CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*got))


def _nearest(q_id, q, c_id, c, v, nv, by, size, start, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For some queries; v: the different ones of the candidates c, each ``size`` times, from ``start`` on in ``by``."""
    nq = np.sqrt((q * q).sum(1))
    s = (q / nq[:, None]) @ (v / nv[:, None]).T
    kk = min(k + 1, len(v))
    low = np.partition(s, len(v) - kk, axis=1)[:, len(v) - kk] - 1e-9
    qi, vi = np.nonzero(s >= low[:, None])
    take = np.minimum(size[vi], k + 1)
    qi2 = np.repeat(qi, take)
    ends = np.cumsum(take)
    pos = np.arange(ends[-1]) - np.repeat(ends - take, take) + np.repeat(start[vi], take)
    ci = by[pos]
    keep = c_id[ci] != q_id[qi2]
    qi2, ci = qi2[keep], ci[keep]
    score = (q[qi2] * c[ci]).sum(1) / (nq[qi2] * np.sqrt((c[ci] * c[ci]).sum(1)))
    order = np.lexsort((c_id[ci], -score, qi2))
    qi2, ci, score = qi2[order], ci[order], score[order]
    n = np.bincount(qi2, minlength=len(q))
    rank = np.arange(len(qi2)) - np.repeat(np.cumsum(n) - n, n)
    m = rank < k
    return q_id[qi2[m]], c_id[ci[m]], score[m]


_FOUND = "query_id long, vec_id long, score double"


def search(
    rows: DataFrame,
    queries: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    sample: int = SAMPLE,
    part_rows: int = PART_ROWS,
    max_parts: int = MAX_PARTS,
    target: float = TARGET,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows for which ``queries`` holds, the k nearest others."""
    spark = rows.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    dims = rows.filter(vec.isNotNull()).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dims[0]["d"] if dims else 1
    some = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(queries, F.lit(False)).alias("q"))
    some = some.filter(_valid(F.col("vec"), dim))
    total = some.count()
    if total < LEAST:
        first = alone(dim)
    else:
        few = _sampled(some, sample, total).orderBy(F.xxhash64("id", F.lit(7)), "id", "vec").limit(sample).select("vec").toArrow()
        first = learn(_matrix(few.column("vec").combine_chunks(), dim), min(max_parts, 1 << int(math.log2(total) / 2)), k, target)
    per_part = lambda t: {r["part"]: r["n"] for r in t.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # noqa: E731  a row a part
    index = stored(_route(some.select("id", "vec"), first, {}, dim, False), "index")
    size = per_part(index)
    more = _learn_parts(index, size, part_rows, sample, dim, k, target)
    if more:
        coarse, index = index, stored(_route(index.select("id", "vec"), first, more, dim, False), "index")
        discard(coarse)
        size = per_part(index)
    asked = stored(_route(some.filter("q").select("id", "vec"), first, more, dim, True), "asked")
    number = per_part(asked)
    # blocks of a part, of rows and of queries: each pair of blocks meets once. The queries of a part are
    # mostly one block, so its rows move once.
    block = max(64, block_bytes // (8 * dim))
    cut = [(p, -(-n // block), -(-number[p] // (2 * block))) for p, n in size.items() if p in number]
    blocks = F.broadcast(spark.createDataFrame(cut, "part int, nb int, nq int"))
    left = index.join(blocks, "part").withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.col("nb")).cast("int"))
    left = left.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    right = asked.join(blocks, "part").withColumn("a", F.pmod(F.xxhash64("id", F.lit(2)), F.col("nq")).cast("int"))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    both = left.select("part", "a", "b", F.lit(False).alias("q"), "id", "vec").unionByName(right.select("part", "a", "b", F.lit(True).alias("q"), "id", "vec"))

    def compare(t: pa.Table) -> pa.Table:
        q = t.column("q").combine_chunks().to_numpy(zero_copy_only=False)
        ids = t.column("id").to_numpy()
        vec = t.column("vec").combine_chunks()
        x = _matrix(vec if isinstance(vec, pa.Array) else vec.chunk(0), dim)
        if q.all() or not q.any():
            got = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        else:
            got = _best(ids[q], x[q], ids[~q], x[~q], k)
        return pa.table([pa.array(a) for a in got], ["query_id", "vec_id", "score"])

    found = both.groupBy("part", "a", "b").applyInArrow(compare, _FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
