"""Nearest neighbours by largest inner product, with a vantage-point tree per shard.

Inner products become distances by one more component: with M the largest norm,
|(q, 0) - (x, sqrt(M^2 - |x|^2))|^2 = |q|^2 + M^2 - 2 q.x. Each shard holds a
tree over its distinct vectors; every node has a vantage point and the least and
largest distance to it on either side. A side is left out if ``factor`` times
its lower bound, by the triangle inequality, is over the k-th best distance so
far: factor 1 is exact search, a larger factor leaves out more.

Vectors are dealt to shards of bounded size by a hash of their id and all of
them are indexed (copies share a tree entry that lists their ids). Queries go in
blocks of bounded size to all shards; each shard answers with its k nearest and
the k best of these remain. Final scores are inner products of the original
vectors in double precision; ties go to the smaller id.

Nulls and edge cases: vectors that are null or zero, or hold null or non-finite
components take no part, nor do rows with a null id. Vectors of different lengths
have no inner product: each length, of which a table has few, is searched by
itself. A query is never its own neighbour; rows that repeat its id are
left out with it, the smallest of their vectors is the query, and of other
repeated ids each row counts. With fewer than k
candidates all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import stored

#: Vectors of a shard, and queries of a block, about.
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
LEAF = 96
#: Pruning factor of the registered query; 1 is exact.
FACTOR = 1.0


class Tree:
    """Vantage-point tree over the distinct vectors of a shard, in an order where each node is a range."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        first = np.r_[True, (vectors[1:] != vectors[:-1]).any(1)] if len(ids) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        self.ids, self.begin, self.end = ids, starts, np.r_[starts[1:], len(ids)]
        self.vectors = vectors[starts]
        #: Of each entry, its smallest id, and whether it has no other.
        self.least, self.alone = ids[starts], ids[starts] == ids[self.end - 1]
        x = self.vectors.astype(np.float64)
        lifted = np.c_[x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))]
        #: lo, hi, row of the vantage point, its vector; then the children and their distance ranges.
        self.nodes: list[tuple] = []
        self.order = np.arange(len(lifted))
        if len(lifted):
            self._build(lifted, 0, len(lifted))

    def _build(self, points: np.ndarray, lo: int, hi: int) -> int:
        me = len(self.nodes)
        self.nodes.append((lo, hi, None))
        if hi - lo > LEAF:
            inside = self.order[lo:hi]
            far = np.linalg.norm(points[inside] - points[inside[0]], axis=1)
            vantage = points[inside[int(far.argmax())]]
            d = np.linalg.norm(points[inside] - vantage, axis=1)
            rank = np.argsort(d, kind="stable")
            self.order[lo:hi], d = inside[rank], d[rank]
            mid = (hi - lo) // 2
            ranges = (d[0], d[mid - 1], d[mid], d[-1])
            near = self._build(points, lo, lo + mid)
            away = self._build(points, lo + mid, hi)
            self.nodes[me] = (lo, hi, (vantage, near, away, ranges))
        return me

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, top: float) -> Iterator[tuple[int, int, float]]:
        """(query's place, id, score) of the k nearest rows of each query in this shard."""
        n = len(queries)
        if not len(self.nodes) or not n:
            return
        q = queries.astype(np.float64)
        square = (q * q).sum(1)
        lifted = np.c_[q, np.zeros(n)]
        x = self.vectors.astype(np.float64)
        slack = 1e-9 * (1 + top + np.sqrt(square * top))
        best = np.full((n, k + 1), -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def scored(active: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """Inner products; entries that hold the query's id only are no candidates and give no bound."""
            own = self.alone[rows] & (ids[active][:, None] == self.least[rows])
            return np.where(own, -np.inf, q[active] @ x[rows].T)

        def distance() -> np.ndarray:
            return np.sqrt(np.maximum(0.0, square + top - 2 * best[:, 0])) + slack

        def first(node: int, active: np.ndarray) -> None:
            """Only the nearer side: gives each query a k-th best to prune by."""
            lo, hi, inner = self.nodes[node]
            if not len(active):
                return
            if inner is None:
                scores = scored(active, self.order[lo:hi])
                if scores.shape[1] > k:
                    best[active] = np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, -k - 1 :]
                    best[active, 0] = best[active].min(1)
                return
            vantage, near, away, ranges = inner
            d = np.linalg.norm(lifted[active] - vantage, axis=1)
            closer = d <= (ranges[1] + ranges[2]) / 2
            first(near, active[closer])
            first(away, active[~closer])

        def walk(node: int, active: np.ndarray) -> None:
            lo, hi, inner = self.nodes[node]
            if inner is None:
                rows = self.order[lo:hi]
                scores = scored(active, rows)
                take, column = np.nonzero(scores >= (best[active, 0] - slack[active])[:, None])
                if len(take):
                    kept.append((active[take], rows[column], scores[take, column]))
                both = np.concatenate([found[active], scores], axis=1)
                found[active] = np.partition(both, both.shape[1] - k - 1, axis=1)[:, -k - 1 :]
                best[active, 0] = np.maximum(best[active, 0], found[active].min(1))
                return
            vantage, near, away, (near_low, near_high, away_low, away_high) = inner
            d = np.linalg.norm(lifted[active] - vantage, axis=1)
            for child, low, high in ((near, near_low, near_high), (away, away_low, away_high)):
                bound = np.maximum(0.0, np.maximum(d - high, low - d))
                go = active[factor * bound <= distance()[active]]
                if len(go):
                    walk(child, go)

        found = np.full((n, k + 1), -np.inf)
        every = np.arange(n)
        first(0, every)
        walk(0, every)
        if not kept:
            return
        who, row, score = (np.concatenate(c) for c in zip(*kept))
        near = score >= best[who, 0] - slack[who]
        who, row = who[near], row[near]
        exact = np.einsum("ij,ij->i", q[who], x[row])
        order = np.lexsort((-exact, who))
        bounds = np.flatnonzero(np.r_[True, np.diff(who[order]) != 0, True])
        for a, b in zip(bounds[:-1], bounds[1:]):
            rows = order[a:b]
            own = ids[who[rows[0]]]
            # of one tree entry only the k smallest ids other than the query's can be among its k nearest
            others = ((r, self.ids[self.begin[row[r]] : self.end[row[r]]]) for r in rows)
            pairs = [(-exact[r], int(i)) for r, held in others for i in held[held != own][:k]]
            for negative, i in sorted(pairs)[:k]:
                yield int(who[rows[0]]), i, float(-negative)


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("v"))
    return rows.where("vec_id is not null and v is not null").where(~odd & F.exists("v", lambda x: x != 0))


def _packed(rows: DataFrame, parts: int, name: str, make) -> DataFrame:
    """One row a part: the part's number and what ``make`` gives for its ids and vectors, pickled."""

    def group(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        lists = table.column("v").combine_chunks()
        vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        part = table.column(name)[0].as_py()
        return pa.table({name: pa.array([part], pa.int32()), f"{name}_data": pa.array([pickle.dumps(make(ids, vectors))], pa.binary())})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    return dealt.groupBy(name).applyInArrow(group, f"{name} int, {name}_data binary")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", column: str = "embedding", factor: float = FACTOR, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with each query row.

    ``is_query`` is a condition on ``vec_id``; all other rows of the table are its candidates.
    """
    rows = stored(usable(vectors, key, column), "vectors")
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    found = [_nearest(rows.where(F.size("v") == n), is_query, k, factor, shard_rows) for n in lengths or [0]]
    return reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, is_query: Column, k: int, factor: float, shard_rows: int) -> DataFrame:
    """``nearest`` among usable vectors of one length."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    queries = rows.where(is_query)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).first()
    top, shards = (totals["top"] or 0.0) * (1 + 1e-12), max(1, math.ceil(totals["n"] / shard_rows))
    blocks = max(1, math.ceil(queries.count() / BLOCK_ROWS))

    trees = _packed(rows, shards, "shard", lambda ids, v: Tree(ids, v, top))
    asked = _packed(queries.groupBy("vec_id").agg(F.min("v").alias("v")), blocks, "block", lambda ids, v: (ids, v))
    pairs = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(trees, "shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, v = pickle.loads(batch.column(0)[i].as_py())
                tree = pickle.loads(batch.column(1)[i].as_py())
                found = list(tree.search(ids, v, k, factor, top))
                columns = [ids[[f[0] for f in found]] if found else [], [f[1] for f in found], [f[2] for f in found]]
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "vec_id", "score"])

    found = pairs.select("block_data", "shard_data").mapInArrow(search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
