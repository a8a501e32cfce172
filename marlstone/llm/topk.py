"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists, in blocks.

Vectors are dealt into blocks of bounded size, queries into chunks; every chunk
meets every block once, by an equi-join on both numbers.  Within a block each
dimension has its list of vectors sorted by value.  A query walks all lists in
step, from the end that its component's sign favours, looks up the full score of
every vector it meets, and stops as soon as the bound that the current depth
implies for unseen vectors is below its k-th best score, or when it has met every
vector.  The bound is the greatest product with a vector that is below the lists'
current values in every dimension and no longer than the block's longest.  The best
k of each block are merged per query.

Defined results: vectors that are null or hold null or non-finite components,
and rows with a null id, take no part; components are floored multiples of
1/256; shorter vectors count as padded with zeros; a row never meets rows of its
own id; an id that occurs in several rows is one query (its greatest vector) but
as many candidates; ties go to the smaller id; scores beyond 64 bits are held at
the ends of the range; columns beyond id and vector are left out, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block and queries in a chunk, at most about so many.
BLOCK_ROWS, CHUNK_QUERIES = 24_576, 4_096


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _widen(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


class Block:
    """Vectors with their sorted lists."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")  # so the first of equal scores has the smallest id
        self.ids, self.v = ids[order], v[order]
        self.lists = np.argsort(-self.v, axis=0, kind="stable").T.copy()
        self.longest = float((self.v * self.v).sum(axis=1).max(initial=0.0))  # squared
        #: Queries, those that the bound stopped before they had met every vector, and vectors met in all.
        self.asked = self.stopped = self.met = 0

    def bound(self, a: np.ndarray, b: np.ndarray) -> float:
        """Greatest sum of ``a * u`` with u at most ``b`` everywhere and no longer than the longest vector (``a`` > 0)."""
        ratio = b / a
        order = np.argsort(ratio, kind="stable")
        a, b, ratio = a[order], b[order], ratio[order]
        # u is b up to a place, and proportional to a from there on
        fixed = np.concatenate([[0.0], np.cumsum(b * b)])
        free = np.concatenate([np.cumsum((a * a)[::-1])[::-1], [0.0]])
        if fixed[-1] <= self.longest:
            return float(a @ b)
        place = int(np.argmax(fixed[:-1] + np.maximum(ratio, 0.0) ** 2 * free[:-1] >= self.longest))
        scale = np.sqrt(max(self.longest - fixed[place], 0.0) / free[place])
        return float(a[:place] @ b[:place] + scale * free[place])

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= kth
            rows, scores = rows[keep], scores[keep]
        top = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[top], scores[top]

    def threshold(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the best k."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        if not len(dims):  # no list matters: all scores are 0
            rows = np.flatnonzero(self.ids != own)[:k]
            return rows, np.zeros(len(rows))
        down = q[dims] > 0
        seen = np.zeros(n, bool)
        rows, scores = np.empty(0, np.int64), np.empty(0)
        depth, last = min(16, n), 0
        while True:
            before = seen.copy()
            for dim, from_top in zip(dims, down, strict=True):
                seen[self.lists[dim, last:depth] if from_top else self.lists[dim, n - depth : n - last]] = True
            new = np.flatnonzero(seen & ~before)
            new = new[self.ids[new] != own]
            rows, scores = self._best(np.concatenate([rows, new]), np.concatenate([scores, self.v[new] @ q]), k)
            edge = self.lists[dims, np.where(down, depth - 1, n - depth)]
            most = self.bound(np.abs(q[dims]), np.where(down, 1.0, -1.0) * self.v[edge, dims])
            done = len(rows) == k and scores[-1] > most + 1e-9 * (abs(most) + self.longest)
            if done or seen.all():
                met = int(seen.sum())
                self.asked, self.stopped, self.met = self.asked + 1, self.stopped + (met < n), self.met + met
                return rows, scores
            depth, last = min(depth * 2, n), depth

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple]:
        width = max(q.shape[1], self.v.shape[1])
        q, self.v = _widen(q, width), _widen(self.v, width)
        if self.lists.shape[0] < width:
            flat = np.tile(np.arange(len(self.ids)), (width - self.lists.shape[0], 1))
            self.lists = np.concatenate([self.lists, flat])
        out = []
        for i, own in enumerate(query_ids):
            out += [(own, self.ids[r], s) for r, s in zip(*self.threshold(q[i], own, k), strict=True)]
        return out


def _exact(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple]:
    """For components so large that doubles would round: unbounded integers."""
    vi = [[int(x) for x in row] for row in v]
    out = []
    for own, row in zip(query_ids, q, strict=True):
        a = [int(x) for x in row]
        held = lambda s: min(max(s, -(2**63)), 2**63 - 1)
        scored = [(-held(sum(x * y for x, y in zip(a, b, strict=False))), i) for i, b in zip(ids, vi, strict=True) if i != own]
        out += [(own, i, -s) for s, i in sorted(scored)[:k]]
    return out


def search_block(ids: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple]:
    size = lambda m: float(np.abs(m).max(initial=0.0))
    if size(v) * size(q) * max(v.shape[1], q.shape[1], 1) >= 2.0**53:
        return _exact(ids, v, query_ids, q, k)
    return Block(ids, v).search(query_ids, q, k)


def usable(vector: Column) -> Column:
    x = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` rows of ``vectors`` for each query (both: id, vector)."""

    def scaled(df: DataFrame) -> DataFrame:
        return df.filter(F.col("id").isNotNull() & usable(F.col("vector"))).select("id", F.transform(F.col("vector").cast("array<double>"), lambda x: F.floor(256 * x).cast("double")).alias("v"))

    data, asked = scaled(vectors), scaled(queries).groupBy("id").agg(F.max("v").alias("v"))
    sizes = [r["n"] for r in data.agg(F.count("*").alias("n")).unionAll(queries.agg(F.countDistinct("id").alias("n"))).collect()]
    cores = data.sparkSession.sparkContext.defaultParallelism
    chunks = -(-max(sizes[1], 1) // CHUNK_QUERIES)
    blocks = max(-(-max(sizes[0], 1) // BLOCK_ROWS), min(cores // chunks, sizes[0] // 4096), 1)
    left = data.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asked.withColumn("c", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows = search_block(d["id"].to_numpy(), _matrix(d["v"]), q["id"].to_numpy(), _matrix(q["v"]), k) if len(d) and len(q) else []
        return pd.DataFrame([(int(a), int(b), int(s)) for a, b, s in rows], columns=["query_id", "vec_id", "score"], dtype="int64")

    met = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
